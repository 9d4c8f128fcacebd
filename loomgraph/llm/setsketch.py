"""Near-duplicate documents by SetSketch registers: banded, estimated by joint likelihood, verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, row_key, small_batches, written

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(32)


class Shingler:
    """Sets of hashed word shingles. A-Z become lower case, words are split at ASCII white space.

    Hashes have 64 bits; words keep theirs, at most ``limit`` of them. A text with fewer words than a shingle has one
    element, its whole sequence; a text without words has none.
    """

    def __init__(self, size: int = 5, limit: int = 120_000):
        self.size, self.limit = size, limit
        self.words: dict[bytes, int] = {}
        self.kept = 0  # bytes of the words

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.limit or self.kept > 64 * self.limit:
                known.clear()
                self.kept = 0
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
                    self.kept += len(w)
            h = np.array([known[w] for w in words], np.uint64)
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ (out >> _FOLD)) * _PRIME + h[k : len(h) - n + 1 + k]
        return np.unique((out ^ (out >> _FOLD)) * _PRIME)


class SetSketch:
    """``registers`` of a set: exponentially spaced, truncated minima of exponential hash values.

    Register i is ``1 - floor(log_base(rate * x_i))`` within 0 and ``limit``, x_i being the smallest of the set's i-th
    exponential hash values. Minima are taken over 32-bit integers first, which order the same way. Registers of a
    union are the maxima of the registers.
    """

    def __init__(self, bands: int = 32, rows: int = 5, base: float = 1.02, rate: float = 20.0, limit: int = 65535, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.base, self.rate, self.limit = bands, rows, base, rate, limit
        self.size = bands * rows
        self.a = rng.integers(0, 1 << 31, self.size, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.size, np.uint32)
        self.mix = rng.integers(0, 1 << 62, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def registers(self, items: np.ndarray, block: int = 1024) -> np.ndarray:
        low = np.full(self.size, 0xFFFFFFFF, np.uint32)
        x = (items >> _FOLD).astype(np.uint32)
        for at in range(0, len(x), block):
            np.minimum(low, (x[at : at + block, None] * self.a + self.b).min(0), out=low)
        value = -np.log1p(-(low + 0.5) / 2**32)
        return np.clip(1 - np.floor(np.log(self.rate * value) / np.log(self.base)) + 1400, 0, self.limit).astype(np.uint16)

    def band_values(self, registers: np.ndarray) -> np.ndarray:
        """One 64-bit value for each band of each row of registers."""
        h = (registers.reshape(-1, self.bands, self.rows).astype(np.uint64) * self.mix).sum(2, dtype=np.uint64)
        return ((h ^ (h >> _FOLD)) * _PRIME).astype(np.int64)

    def may_reach(self, k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray, threshold: float, slack: float = 18.0) -> np.ndarray:
        """Whether a Jaccard similarity of ``threshold`` or more is within ``slack`` of the largest joint log likelihood.

        With known sizes and shares u, v of their sum, a register of the first set is the larger one with probability
        p(u - v J), of the second with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b). A slack of 18 is six standard deviations.
        """
        up, down = (k1 > k2).sum(1)[:, None], (k1 < k2).sum(1)[:, None]
        same = self.size - up - down
        u = (n1 / (n1 + n2))[:, None]
        v = 1 - u
        most = np.minimum(u / v, v / u)
        grid = np.concatenate([np.linspace(0, threshold, 60)[:-1], np.linspace(threshold, 1, 30)])[None, :]
        j = np.minimum(grid, most)
        p = lambda x: -np.log1p(-np.maximum(x, 0) * (self.base - 1) / self.base) / np.log(self.base)
        p1, p2 = p(u - v * j), p(v - u * j)
        log = lambda x: np.log(np.maximum(x, 1e-12))
        likely = up * log(p1) + down * log(p2) + same * log(1 - p1 - p2)
        high = np.where(j >= np.minimum(threshold, most), likely, -np.inf).max(1)
        return (high >= likely.max(1) - slack) & (most[:, 0] >= threshold - 1e-9)


def sketches(docs: DataFrame, sketch: SetSketch, words: int = 5) -> DataFrame:
    """``(doc_id, row_key, n, set_id, registers)`` for every row of ``docs(doc_id, text)``; empty sets have null registers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for b in batches:
            sets = [shingler(t or "") for t in b["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"].astype("Int64"),
                    "row_key": b["row_key"],
                    "n": [len(s) for s in sets],
                    "set_id": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "registers": [sketch.registers(s).tobytes() if len(s) else None for s in sets],
                }
            )

    keyed = docs.select("doc_id", "text", row_key())
    return keyed.mapInPandas(run, "doc_id long, row_key binary, n long, set_id binary, registers binary")


def _banded(classes: DataFrame, sketch: SetSketch) -> DataFrame:
    """``(bucket, c)``: a row for each band of each class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                values = sketch.band_values(np.frombuffer(b"".join(f["registers"]), np.uint16).reshape(len(f), -1))
                yield pd.DataFrame({"bucket": values.ravel(), "c": np.repeat(f["c"].to_numpy(), sketch.bands)})

    return classes.select("c", "registers").mapInPandas(run, "bucket long, c long")


def _groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal keys, from batches in which they follow one another."""
    rest: pd.DataFrame | None = None
    for f in batches:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        k = f[key].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield f.iloc[a:b]
        rest = f.iloc[edges[-1] :]
    if rest is not None and len(rest):
        yield rest


def _short_sets(texts: DataFrame, words: int) -> DataFrame:
    """``(c, items)``: the set of each text as sorted 32-bit hash values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for b in batches:
            yield pd.DataFrame({"c": b["c"], "items": [np.unique((shingler(t) >> _FOLD).astype(np.uint32)).tobytes() for t in b["text"]]})

    return texts.mapInPandas(run, "c long, items binary")


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _compared(rows: DataFrame, sketch: SetSketch, threshold: float, nearest: int | None, tile: int = 768, within: bool = False, tasks: int = 0) -> DataFrame:
    """Pairs ``(a, b)`` of a bucket's classes that may reach the threshold and have different roots.

    ``rows(bucket, size, c, n, registers, root, items)``. Buckets of more than ``tile`` classes are cut into blocks, and each pair of blocks is
    a task's unit of work, compared by matrix operations; only surviving pairs come out. With ``within`` a block meets none but itself, so no row is
    copied; blocks are dealt anew in each bucket. With columns ``top`` and ``top_n``, a bucket's commonest root and its
    classes, those are never paired with one another: their rows go to the blocks of the others alone, so a bucket that is nearly all one
    component costs its size times the few others. With ``nearest`` each class keeps just so many
    partners, those with most equal registers. Otherwise every pair is looked at in the first band it shares, and if registers
    allow it, its sets of 32-bit hash values, which must reach the threshold but for what colliding values can hide. ``tasks`` is the least
    number of partitions.
    """
    blocks = lambda n: F.ceil(n / tile).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("c", "bucket"), F.greatest(n, F.lit(1))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    if within:
        cut = rows.withColumn("block", deal(blocks(F.col("size")))).withColumn("units", F.array(pair(F.col("block"), F.col("block"))))
    else:
        top = F.col("root") == F.col("top") if "top" in rows.columns else F.lit(False)
        many = F.col("top_n") if "top" in rows.columns else F.lit(0)
        cut = rows.withColumn("tops", blocks(many)).withColumn("others", blocks(F.col("size") - many))
        cut = cut.withColumn("block", F.when(top, -1 - deal(F.col("tops"))).otherwise(deal(F.col("others"))))
        mine = F.transform(upto(F.col("others")), lambda o: pair(F.least("block", o), F.greatest("block", o)))
        theirs = F.transform(upto(F.col("tops")), lambda t: pair(-1 - t, F.col("block")))
        cut = cut.withColumn("units", F.when(top, mine).otherwise(F.concat(mine, theirs)))
    units = cut.select("*", F.explode("units").alias("unit")).select("bucket", "unit.i", "unit.j", "c", "n", "registers", "root", "block", "items")
    partitions = max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    units = units.repartition(partitions, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "c")

    def pairs(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        c, n, root, block = (g[k].to_numpy() for k in ("c", "n", "root", "block"))
        regs = np.frombuffer(b"".join(g["registers"]), np.uint16).reshape(len(g), -1)
        i, j = g["i"].iloc[0], g["j"].iloc[0]
        left, right = (np.arange(len(g)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
        items = None if nearest is not None else [np.frombuffer(x, np.uint32) for x in g["items"]]
        found_a, found_b, found_same = [], [], []
        step = max(1, (1 << 22) // max(1, len(right) * sketch.size))
        for at in range(0, len(left), step):
            l = left[at : at + step]
            ok = (root[l][:, None] != root[right]) & (np.minimum(n[l][:, None], n[right]) >= np.maximum(n[l][:, None], n[right]) * threshold - 1e-9)
            if i == j:
                ok &= l[:, None] < right
            a, b = np.nonzero(ok)
            if not len(a):
                continue
            a, b = l[a], right[b]
            for k in range(0, len(a), 1 << 14):
                x, y = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                same = regs[x] == regs[y]
                keep = same.sum(1) >= 0.5 * threshold * sketch.size
                if nearest is None:
                    whole = same.reshape(len(x), sketch.bands, sketch.rows).all(2)
                    values = sketch.band_values(regs[x])
                    keep &= values[np.arange(len(x)), whole.argmax(1)] == g["bucket"].iloc[0]
                x, y, same = x[keep], y[keep], same[keep].sum(1)
                may = sketch.may_reach(regs[x], regs[y], n[x].astype(float), n[y].astype(float), threshold) if len(x) else np.zeros(0, bool)
                if items is not None:
                    for at_pair in np.flatnonzero(may):
                        one, two = int(x[at_pair]), int(y[at_pair])
                        lost = int(n[one] + n[two]) - len(items[one]) - len(items[two])  # by colliding values
                        common = _overlap(items[one], items[two]) + lost
                        may[at_pair] = common >= threshold * (n[one] + n[two] - common) - 1e-9
                found_a.append(x[may])
                found_b.append(y[may])
                found_same.append(same[may])
        if not found_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b, same = (np.concatenate(v) for v in (found_a, found_b, found_same))
        if nearest is not None and len(a) > nearest:
            both, back, likeness = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2), np.tile(same, 2)
            order = np.lexsort((-likeness, both))
            place = np.arange(len(order)) - np.searchsorted(both[order], both[order])
            best = np.unique(back[order][place < nearest])
            a, b = a[best], b[best]
        return np.minimum(c[a], c[b]), np.maximum(c[a], c[b])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_a, out_b, held = [], [], 0
        for g in _groups(batches, ["bucket", "i", "j"]):
            if len(g) > 1:
                a, b = pairs(g)
                out_a.append(a)
                out_b.append(b)
                held += len(a)
                if held > 20_000:
                    yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
                    out_a, out_b, held = [], [], 0
        if out_a:
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return units.mapInPandas(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs whose full sets have ``100 * intersection >= percent * union``; the set of b is kept from row to row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, last, held = Shingler(words), None, None
        for f in batches:
            keep = []
            for b, ta, tb in zip(f["b"], f["ta"], f["tb"], strict=True):
                if b != last:
                    last, held = b, shingler(tb)
                own = shingler(ta)
                common = len(np.intersect1d(own, held, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(held) - common))
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    one, two = texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), texts.select(F.col("c").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, sketch: SetSketch | None = None, broadcast_rows: int = 1_000_000, tile: int = 384, task_rows: int = 50_000) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, row_key)`` for every row of ``docs(doc_id, text)``.

    Documents with ``100 * intersection >= percent * union`` of their shingle sets are linked; component_id is the smallest
    doc_id that links reach. Null, empty and blank texts have an empty set and are linked with nothing. Rows with equal sets are one
    class from the start and are never paired. Null doc_ids take part; their component_id is the smallest id reached, or null.
    Of repeated ids in a component all rows with the smallest id are kept. Other columns are ignored.

    32 bands of 5 registers find a pair at 0.85 with a probability of more than 1 - 1e-8. Inside a band value's bucket
    classes are compared by registers: first every class gives its few nearest partners, whose links join nearly all of
    a group of near copies, so such a group costs a few verifications for each member; then every pair that is still in different
    components and may reach the threshold by the joint likelihood is compared where it lies, on short hash sets, so that only
    links leave a task. All are settled on full sets. The first pass cuts large buckets into blocks (half of ``tile``) that meet none but themselves, dealt
    anew in each band; the second leaves out pairs of a bucket's commonest component.
    Texts of classes in shared buckets are fetched once, by a broadcast of their keys if those are at most ``broadcast_rows``, else by
    a shuffle. All tables are written to the shared folder and deleted once no step reads them, but the two that the result is
    read from; the driver gathers nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sketch = sketch or SetSketch()
    threshold = percent / 100
    rows = written(sketches(docs, sketch, words), "sketches")
    one = rows.where("n > 0").groupBy("set_id").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    # the numbers are stored with the table, so they stay the same however often it is read
    classes = written(one.select("*", F.monotonically_increasing_id().alias("c")), "classes")
    banded = _banded(classes, sketch)
    sizes = written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = written(banded.join(sizes, "bucket"), "shared")
    sketched = classes.select("c", "n", "registers")
    wanted = written(shared.select("c").distinct().join(classes.select("c", "row_key"), "c"), "wanted")
    keys = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    texts = written(docs.select(row_key(), "text").join(keys, "row_key").dropDuplicates(["c"]).select("c", "text"), "texts")
    alone = shared.join(sketched, "c").withColumn("root", F.col("c")).withColumn("items", F.lit(None).cast("binary"))
    near = written(_compared(alone, sketch, threshold, nearest=2, tile=max(2, tile // 2), within=True, tasks=shared.count() // task_rows), "pairs")
    links = written(_verified(near, texts, percent, words), "links")
    roots = components(links)

    def rooted(frame: DataFrame) -> DataFrame:
        return frame.join(roots.select(F.col("id").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))

    placed = written(rooted(shared), "placed")
    per_root = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket")
    mixed = per_root.agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("k", "root")).alias("most")).where("roots > 1")
    several = written(mixed.select("bucket", F.col("most.root").alias("top"), F.col("most.k").alias("top_n")), "several")
    mixed = written(placed.join(several, "bucket"), "mixed")
    sets = _short_sets(texts.join(mixed.select("c").distinct(), "c", "left_semi"), words)
    sets = written(sets.join(sketched, "c"), "sets")
    cross = _compared(mixed.join(sets, "c"), sketch, threshold, nearest=None, tile=tile, tasks=mixed.count() // task_rows).join(near, ["a", "b"], "left_anti")
    more = written(_verified(cross, texts, percent, words), "links")
    if not more.isEmpty():
        first, roots = roots, components(links.unionByName(more))
        discard(first)
    of_set = written(rooted(classes.select("set_id", "c")).select("set_id", "root"), "roots")
    members = written(rows.select("doc_id", "n", "set_id", "row_key").join(of_set, "set_id", "left").select("doc_id", "n", "row_key", "root"), "members")
    # written, so that both sides of the join are plain shuffles, which a component with very many members lets Spark split
    smallest = written(members.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")), "smallest")
    discard(rows, classes, sizes, shared, wanted, texts, near, links, placed, several, mixed, sets, more, roots, of_set)
    out = members.join(smallest, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row_key")

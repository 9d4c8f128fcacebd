"""Alignment of two tokenizers over a corpus: groups of tokens between common ends, interned once, and counts of the id pairs they link."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settled, small_batches

#: Texts are aligned in lots of about so many characters, which bounds memory.
LOT = 2_000_000
_PLAIN = "ɐ"
_BLANK = "▁"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups array<string>, times array<int>, again array<long>"


def chunks(text: str) -> list[str]:
    """``text`` cut before every blank or line feed behind something that isn't white space.

    No token of either vocabulary reaches over such a place, so the tokens of the text are those of its chunks in turn.
    """
    if "\x01" in text:
        parts = [text[0]]
        for before, c in zip(text, text[1:], strict=False):
            if c in " \n" and not before.isspace():
                parts.append(c)
            else:
                parts[-1] += c
        return parts
    parts = text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")
    return parts if parts[0] else parts[1:]


def joined(parts: list[str]) -> list[str]:
    """Parts that end in white space, put together with what follows."""
    out: list[str] = []
    for p in parts:
        if out and out[-1][-1].isspace():
            out[-1] += p
        else:
            out.append(p)
    return out


class Aligner:
    """Both tokenizers, with the byte length of every token, and the groups and links of a text's chunks.

    Byte-level ids come from the ranks file of the same vocabulary, which is several times faster than the tokenizer's own, for characters below
    U+0250; others take the tokenizer itself. Special tokens' strings are plain text in both.
    """

    def __init__(self, bytes_path: str, ranks_path: str, pieces_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(bytes_path)
        self.full.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.blank = self.pieces.piece_to_id(_BLANK)
        self.a_bytes = {i: b for b, i in ranks.items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(_BLANK, " ").encode() for i in range(self.pieces.get_piece_size()) for p in (self.pieces.id_to_piece(i),)]
        self.a_size, self.b_size = np.zeros(max(ranks.values()) + 2, np.int64), np.array(list(map(len, self.b_bytes)), np.int64)
        self.a_size[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))

    def ids(self, text: str, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of both kinds of a chunk, or of chunks in turn; ``plain`` if no character is beyond U+024F."""
        a = self.fast.encode_ordinary(text) if plain else self.full.encode(text, add_special_tokens=False).ids
        # the model puts a blank before what it gets, and none before nothing; a chunk either starts with a blank or doesn't take it up
        b = self.pieces.encode(text[1:] if text[0] == " " else text, num_threads=1) or [self.blank]
        return np.array(a, np.int64), np.array(b if text[0] == " " else b[1:], np.int64)

    def cut(self, texts: list[str], plain: bool) -> tuple[np.ndarray, ...] | None:
        """``(a, b, end_a, end_b, chunk)`` of chunks in turn: their tokens, where each group of them ends among these, and its chunk. None if any token's bytes aren't the text's."""
        whole = "".join(texts)
        a, b = self.ids(whole, plain)
        data = whole.encode("utf-8", "surrogatepass")
        if b"".join([self.a_bytes[x] for x in a.tolist()]) != data or b"".join([self.b_bytes[x] for x in b.tolist()]) != data:
            return None
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ends = np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in texts])
        chunk = np.searchsorted(ends, both)
        if len(np.intersect1d(ends, both, assume_unique=True)) < len(ends):
            return None
        return a, b, np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1, chunk

    def links(self, group: str) -> list[int]:
        """``a << 16 | b`` for every pair of tokens in a group whose bytes overlap."""
        left, right = group.split("|")
        a, b = [int(x) for x in left.split(",")], [int(x) for x in right.split(",")]
        if len(a) == 1:
            return [a[0] << 16 | y for y in b]
        if len(b) == 1:
            return [x << 16 | b[0] for x in a]
        out, i, j, end_a, end_b = [], 0, 0, len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
        while True:
            out.append(a[i] << 16 | b[j])
            if end_a == end_b and i + 1 == len(a):
                return out
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a:
                i += 1
                end_a += len(self.a_bytes[a[i]])
            if step_b:
                j += 1
                end_b += len(self.b_bytes[b[j]])


class _Rows:
    """Rows of integers that grow at the end."""

    def __init__(self, *shape: int):
        self.held, self.n = np.zeros((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros((self.n + len(rows), *self.held.shape[1:]), np.int64)])
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


#: Numbers of chunks without tokens, and of chunks that end in white space and have to be joined with the next one.
_NONE, _OPEN = -2, -1
#: Before the last chunk of a text that ends in white space; no chunk starts with it.
_END = "\x02"


class _Interned:
    """A task's chunks and groups by number; to be cleared beyond ``limit`` chunks."""

    def __init__(self, aligner: Aligner, limit: int = 300_000):
        self.aligner, self.limit = aligner, limit
        self.clear()

    def clear(self) -> None:
        self.chunk: dict[str, int] = {}
        self.text: list[str] = []  # a chunk's groups, as they are hashed
        self.size = _Rows(3)  # its tokens of both kinds and its groups
        self.members = _Rows()  # groups of all chunks in turn
        self.group: dict[str, int] = {}
        self.names: list[str] = []
        self.pairs = _Rows()  # distinct links of all groups in turn
        self.n_pairs = _Rows()

    def forget(self) -> None:
        if len(self.chunk) > self.limit:
            self.clear()

    def _group(self, name: str) -> int:
        n = self.group.get(name)
        if n is None:
            n = self.group[name] = len(self.names)
            self.names.append(name)
            pairs = np.unique(self.aligner.links(name))
            self.pairs.add(pairs)
            self.n_pairs.add(np.array([len(pairs)]))
        return n

    def _learn(self, fresh: list[str]) -> None:
        """Numbers new chunks. They are tokenized as one text, in smaller ones only if some of them have no tokens; a last one that ends in white space by itself."""
        for plain in (True, False):
            of = [p for p in fresh if (max(p) < _PLAIN) == plain]
            inner = [p for p in of if p[0] != _END]
            for part in ([inner] if inner else []) + [[p] for p in of if p[0] == _END]:
                self._place(part, plain)

    def _place(self, of: list[str], plain: bool) -> None:
        found = self.aligner.cut([p.removeprefix(_END) for p in of], plain)
        if found is None:
            if len(of) > 1:
                half = len(of) // 2
                self._place(of[:half], plain)
                self._place(of[half:], plain)
            else:
                self.chunk[of[0]] = _NONE
            return
        a, b, end_a, end_b, chunk = found
        from_a, from_b = np.concatenate([[0], end_a[:-1]]), np.concatenate([[0], end_b[:-1]])
        groups = np.zeros(len(end_a), np.int64)
        single = (end_a - from_a == 1) & (end_b - from_b == 1)
        codes, at = np.unique(a[from_a[single]] << 16 | b[from_b[single]], return_inverse=True)
        groups[single] = np.array([self._group(f"{c >> 16}|{c & 0xFFFF}") for c in codes.tolist()], np.int64)[at]
        several = np.flatnonzero(~single)
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        spans = zip(from_a[several].tolist(), end_a[several].tolist(), from_b[several].tolist(), end_b[several].tolist(), strict=True)
        groups[several] = [self._group(",".join(a_text[i:j]) + "|" + ",".join(b_text[k:m])) for i, j, k, m in spans]
        n = len(of)
        n_groups = np.bincount(chunk, minlength=n)
        self.size.add(np.stack([np.bincount(chunk, end_a - from_a, n), np.bincount(chunk, end_b - from_b, n), n_groups], 1).astype(np.int64))
        self.members.add(groups)
        names = [self.names[g] for g in groups.tolist()]
        cuts = np.cumsum(n_groups).tolist()
        first = len(self.text)
        self.text += [";".join(names[i:j]) for i, j in zip([0, *cuts], cuts, strict=False)]
        self.chunk.update(zip(of, range(first, first + n), strict=True))

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's chunks; none if a chunk has no tokens."""
        each, fresh = [], {}
        for t in texts:
            parts = chunks(" " + t) if t else []
            new = set(parts).difference(self.chunk)
            self.chunk.update(dict.fromkeys((p for p in new if p[-1].isspace()), _OPEN))
            if any(self.chunk.get(p) == _OPEN for p in parts):
                parts = joined(parts)
                if parts[-1][-1].isspace():
                    parts[-1] = _END + parts[-1]
                new = set(parts).difference(self.chunk)
            fresh.update(dict.fromkeys(p for p in new if p not in self.chunk))
            each.append(parts)
        self._learn(list(fresh))
        get = self.chunk.__getitem__
        out = [list(map(get, parts)) for parts in each]
        return [[] if _NONE in numbers else numbers for numbers in out]


def _spans(starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places ``starts[k] ... starts[k] + count[k] - 1`` for each k in turn."""
    return np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)


def _lists(values: pa.Array, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), values)


def _lot(ids: list[int | None], texts: list[str | None], known: _Interned) -> pa.RecordBatch:
    """The rows of some documents, with all numbers of chunks and groups in arrays."""
    each = [np.array(e, np.int64) for e in known.numbers(texts)]
    n = len(texts)
    chunk, doc = np.concatenate([*each, np.zeros(0, np.int64)]), np.repeat(np.arange(n), list(map(len, each)))
    size = known.size.all
    sums = [np.bincount(doc, size[chunk, k], n).astype(np.int64) for k in range(3)]
    group = known.members.all[_spans((np.cumsum(size[:, 2]) - size[:, 2])[chunk], size[chunk, 2])]
    of_doc, times = np.unique(np.repeat(doc, size[chunk, 2]) << 32 | group, return_counts=True)
    doc, group = of_doc >> 32, of_doc & 0xFFFFFFFF
    n_pairs = known.n_pairs.all
    pair = known.pairs.all[_spans((np.cumsum(n_pairs) - n_pairs)[group], n_pairs[group])]
    pair = np.sort(np.repeat(doc, n_pairs[group]) << 32 | pair)
    pair = pair[1:][pair[1:] == pair[:-1]]
    names = pa.array(known.names, pa.string())
    count = lambda x: np.bincount(x, minlength=n)
    return pa.record_batch(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_a": pa.array(sums[0]),
            "n_b": pa.array(sums[1]),
            "n_groups": pa.array(sums[2]),
            "n_links": pa.array(sums[0] + sums[1] - sums[2]),
            "groups_sha256": pa.array([hashlib.sha256(";".join([known.text[i] for i in e.tolist()]).encode()).hexdigest() if len(e) else "" for e in each], pa.string()),
            "groups": _lists(names.take(pa.array(group)), count(doc)),
            "times": _lists(pa.array(times.astype(np.int32)), count(doc)),
            "again": _lists(pa.array(pair & 0xFFFFFFFF), count(pair >> 32)),
        }
    )


def grouped(docs: DataFrame, load: Callable[[], Aligner], lot: int = LOT) -> DataFrame:
    """A row for every document, see TABLE: its distinct groups, how often each occurs, and each pair as often as further distinct groups of the document link it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Interned(load())
        for b in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                t = t.as_py()
                if held and held + len(t or "") > lot:
                    yield _lot(ids, texts, known)
                    ids, texts, held = [], [], 0
                    known.forget()
                ids.append(i)
                texts.append(t)
                held += len(t or "")
            if ids:
                yield _lot(ids, texts, known)
                known.forget()

    return docs.select("doc_id", "text").mapInArrow(run, TABLE)


def _expanded(groups: DataFrame, load: Callable[[], Aligner]) -> DataFrame:
    """``(number, docs, pair, times)``: the links of each distinct group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load()
        for b in batches:
            for at in range(0, b.num_rows, 10_000):
                part = b.slice(at, 10_000)
                links = [aligner.links(g) for g in part.column("group").to_pylist()]
                count = np.array(list(map(len, links)), np.int64)
                row = np.repeat(np.arange(len(links)), count)
                key, times = np.unique(row << 32 | np.array([x for y in links for x in y], np.int64), return_counts=True)
                row = pa.array(key >> 32)
                yield pa.record_batch({"number": part.column("number").take(row), "docs": part.column("docs").take(row), "pair": pa.array(key & 0xFFFFFFFF), "times": pa.array(times)})

    return groups.select("number", "docs", "group").mapInArrow(run, "number long, docs long, pair long, times long")


def align(docs: DataFrame, bytes_path: str, ranks_path: str, pieces_path: str, common: int = 100_000) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs(doc_id, text)``.

    Tokens A are those of a blank and the text by the byte-level tokenizer, tokens B those of the text by the piece model, which adds the blank. Null and empty texts, and texts
    whose tokens don't give their bytes back, have no tokens: zeros, and an empty digest. Places where tokens of both kinds end cut a
    text into groups; tokens of a group whose bytes overlap are linked. An id pair's count is the number of documents that hold it linked, and a link is best if its
    pair has the highest count of its A id, ties included. Rows are documents of their own, whatever their doc_ids; other columns are ignored.

    Documents bring only their distinct groups and how often each occurs. Groups are interned in a table of distinct ones, and only there are links expanded, once for
    each distinct group. A pair's count is the sum of its groups' documents, less what documents count twice that link it in several groups. Groups' sums go
    back to documents by group: the ``common`` ones in most documents (of at most 200 characters, so a few tens of megabytes) by a broadcast, all others by
    a shuffle, in which none of them can weigh much.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000, 8 << 20)

    def load() -> Aligner:
        return Aligner(bytes_path, ranks_path, pieces_path)

    rows = settled(grouped(docs, load).withColumn("doc", F.monotonically_increasing_id()), "aligned")
    groups = rows.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("docs"))
    groups = settled(groups.withColumn("number", F.monotonically_increasing_id()), "groups")
    links = settled(_expanded(groups, load), "links")
    counted = links.select("pair", "docs").unionByName(rows.select(F.explode("again").alias("pair"), F.lit(-1).cast("long").alias("docs")))
    pairs = settled(counted.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 16)), "pairs")
    highest = F.broadcast(pairs.groupBy("a").agg(F.max("n").alias("most")))  # a row for each id of vocabulary A at most
    marked = pairs.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    sums = links.join(marked, "pair").groupBy("number").agg(F.sum(F.col("times") * F.col("best")).alias("best"), F.sum(F.col("times") * F.col("n")).alias("sum"))
    worth = settled(groups.join(sums, "number").select("group", "docs", "best", "sum"), "worth")
    discard(groups, links, pairs)
    often = settled(worth.where(F.length("group") <= 200).orderBy(F.desc("docs"), "group").limit(common), "often")
    held = rows.select("doc", F.explode(F.arrays_zip("groups", "times")).alias("g")).select("doc", F.col("g.groups").alias("group"), F.col("g.times").alias("times"))
    near = held.join(F.broadcast(often.select("group", "best", "sum")), "group")
    far = held.join(F.broadcast(often.select("group")), "group", "left_anti").join(worth.select("group", "best", "sum"), "group")
    of_doc = near.unionByName(far).groupBy("doc").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("sum")).alias("count_sum"))
    out = rows.select("doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(of_doc, "doc", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

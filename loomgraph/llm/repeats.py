"""Passages that repeat across documents: a count-min prefilter over windows of words, exact grouping of what it lets through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settled, small_batches

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The lowest k bytes of eight.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 512
_ODD = np.random.default_rng(13).integers(0, 1 << 63, (64, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * odd
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a column of texts and 128 bits of a hash for each, in two halves; whole columns at once, no word is a Python object.

    Words are runs of other bytes than ASCII white space. ``first`` has each text's place among all words and, at the end, their number.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        at = offsets - offsets[0]
        plain = ~_SPACE[data]
        begins, ends = plain.copy(), plain.copy()
        begins[1:] &= ~plain[:-1]
        ends[:-1] &= ~plain[1:]
        inner = at[(at > 0) & (at < len(data))]
        begins[inner] = plain[inner]
        ends[inner - 1] = plain[inner - 1]
        starts = np.flatnonzero(begins)
        length = np.flatnonzero(ends) + 1 - starts
        self.first = np.searchsorted(starts, at)
        self.hashes = self._hashes(data, starts, length)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        out = [_mixed(length.astype(np.uint64), odd) for odd in _ODD[0]]
        left = np.flatnonzero(length <= _LONG)
        for k in range(0, _LONG, 8):
            if not len(left):
                break
            lane = eight[starts[left] + k] & _LOWEST[np.minimum(length[left] - k, 8)]
            for h, odd in zip(out, _ODD[1 + k // 8 % 8], strict=True):
                h[left] = _mixed(h[left] ^ lane, odd)
            left = left[length[left] > k + 8]
        for i in np.flatnonzero(length > _LONG).tolist():
            both = xxhash.xxh3_128_intdigest(data[starts[i] : starts[i] + length[i]].tobytes())
            out[0][i], out[1][i] = both >> 64, both & 0xFFFFFFFFFFFFFFFF
        return out[0], out[1]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(one, two, text, place)``: both halves of the hash of each window of ``size`` words inside a text, the text and the place there."""
        count = np.diff(self.first)
        some = np.maximum(count - size + 1, 0)
        text = np.repeat(np.arange(len(count)), some)
        place = np.arange(len(text)) - np.repeat(np.cumsum(some) - some, some)
        n = max(0, len(self.hashes[0]) - size + 1)
        at = self.first[text] + place
        halves = []
        for half, w in enumerate(self.hashes):
            h = np.zeros(n, np.uint64)
            for k in range(size):
                h += w[k : k + n] * _ODD[10 + k, half]
            halves.append(_mixed(h, _ODD[9, half])[at])
        return halves[0], halves[1], text, place


def _once(one: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of one window of each value in each text."""
    order = np.argsort(one + text.astype(np.uint64) * _ODD[8, 1])
    same = (one[order][1:] == one[order][:-1]) & (text[order][1:] == text[order][:-1])
    return order[np.concatenate([[True], ~same])] if len(order) else order


class CountMin:
    """Shape of a count-min sketch: ``rows`` hash functions onto ``cells`` cells, in slabs of ``slab`` cells. Counts stop at 255."""

    def __init__(self, cells: int, rows: int = 3, slab: int = 1 << 20):
        self.cells, self.rows, self.slab = cells, rows, min(cells, slab)
        self.shift = np.uint64(65 - cells.bit_length())

    def cell(self, row: int, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD[40 + row, 0]) >> self.shift).astype(np.uint32)

    def partial(self, keys: np.ndarray) -> pa.RecordBatch:
        """``(row, slab, cells)``: the sketch of some keys, as sorted cells of each slab. They are stored as steps, in planes of equal bytes."""
        rows, slabs, cells = [], [], []
        for row in range(self.rows):
            c = np.sort(self.cell(row, keys))
            cuts = np.searchsorted(c, np.arange(0, self.cells + 1, self.slab, dtype=np.int64))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                steps = np.diff(c[cuts[k] : cuts[k + 1]], prepend=np.uint32(k * self.slab))
                rows.append(row)
                slabs.append(k)
                cells.append(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
        return pa.record_batch({"row": pa.array(rows, pa.int32()), "slab": pa.array(slabs, pa.int32()), "cells": pa.array(cells, pa.binary())})

    def add(self, counts: np.ndarray, cells: bytes) -> None:
        """Adds a partial sketch's cells of one slab to its counts."""
        steps = np.ascontiguousarray(np.frombuffer(cells, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        at = np.cumsum(steps, dtype=np.int64)
        new = np.flatnonzero(np.concatenate([[True], steps[1:] > 0]))
        times = np.diff(np.append(new, len(at)))
        counts[at[new]] = np.minimum(counts[at[new]].astype(np.int64) + times, 255)

    def may_repeat(self, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which keys have an estimate of two or more, from a bit for each cell."""
        left = np.arange(len(keys))
        for row in range(self.rows):
            c = self.cell(row, keys[left])
            left = left[(bits[row][c >> np.uint32(3)] >> (7 - (c & np.uint32(7)))) & 1 > 0]
        return left


def _estimated(texts: DataFrame, sketch: CountMin, size: int, flush: int = 2_000_000) -> DataFrame:
    """``(row, slab, bits)``: a bit for each cell that at least two documents' windows fall on, from the merged sketches of all partitions.

    A task keeps the hash values of at most about ``flush`` windows; a merging task streams through the partial sketches of one slab at a time.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            one, _, text, _ = Words(b.column("text")).windows(size)
            held.append(one[_once(one, text)])
            if sum(map(len, held)) >= flush:
                yield sketch.partial(np.concatenate(held))
                held = []
        if held:
            yield sketch.partial(np.concatenate(held))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch({"row": pa.array([key[0]], pa.int32()), "slab": pa.array([key[1]], pa.int32()), "bits": pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())})

        for b in batches:
            for row, slab, cells in zip(b["row"].to_pylist(), b["slab"].to_pylist(), b["cells"], strict=True):
                if key != (row, slab):
                    if key is not None:
                        yield done()
                    key, counts = (row, slab), np.zeros(sketch.slab, np.uint8)
                sketch.add(counts, cells.as_py())
        if key is not None:
            yield done()

    parts = texts.mapInArrow(sketched, "row int, slab int, cells binary")
    return parts.repartition("row", "slab").sortWithinPartitions("row", "slab").mapInArrow(merged, "row int, slab int, bits binary")


def without_repeats(docs: DataFrame, size: int = 13, most_cells: int = 1 << 28) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs(doc_id, text)``.

    A window is ``size`` consecutive words of a document; words are separated by ASCII white space and otherwise unchanged. Every word covered by a window
    that also starts in a document with a smaller doc_id is removed, as windows are in the input. Null, empty and blank texts have no words. A
    null doc_id is larger than any other; rows with equal doc_ids, null or not, take nothing from one another. Other columns are ignored.

    First, each partition sketches how many documents hold each window, the sketches are merged by slabs of cells, and a bit a cell says whether two or more
    fall on it. Estimates are never too small, so the second pass groups only the windows that may repeat, exactly, by 128 bits of their words' hashes, and
    loses none. The sketch has three rows and twice as many cells as windows, ``most_cells`` a row at most (96 MB of bits in all by default, which is what the
    driver sends to the executors); beyond that it lets more windows through, which the exact step settles all the same. The
    smallest doc_id of a window combines before it is shuffled, and rows meet it in a join of plain shuffles that Spark can split, so a passage that most
    documents share is in no single task.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000, 8 << 20)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    text = docs.select("text")
    n = (text.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // 6  # about so many words
    sketch = CountMin(min(most_cells, max(1 << 16, 1 << (2 * n).bit_length())))
    bits = np.zeros((sketch.rows, (sketch.cells + 7) // 8), np.uint8)
    slabs = settled(_estimated(text, sketch, size), "slabs")
    for r in slabs.toLocalIterator():  # a few files' slabs at a time
        bits[r["row"], r["slab"] * sketch.slab // 8 :][: sketch.slab // 8] = np.frombuffer(r["bits"], np.uint8)
    discard(slabs)
    shared = spark.sparkContext.broadcast(bits)
    del bits

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two, text, place = Words(b.column("text")).windows(size)
            may = sketch.may_repeat(shared.value, one)
            may = may[_once(one[may], text[may])]
            at = pa.array(text[may])
            yield pa.record_batch(
                {
                    "one": pa.array(one[may].view(np.int64)),
                    "two": pa.array(two[may].view(np.int64)),
                    "doc_id": b.column("doc_id").take(at).cast(pa.int64()),
                    "text_hash": b.column("text_hash").take(at),
                    "place": pa.array(place[may].astype(np.int32)),
                }
            )

    found = rows.mapInArrow(candidates, "one long, two long, doc_id long, text_hash long, place int")
    least = F.min("doc_id").alias("least")
    repeated = found.groupBy("one", "two").agg(least, F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("unnamed")).where("least < most OR least IS NOT NULL AND unnamed").select("one", "two", "least")
    repeated = settled(repeated, "repeated")
    later = found.join(repeated, ["one", "two"]).where("doc_id IS NULL OR doc_id > least")
    removed = settled(later.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places")), "removed")
    discard(repeated)
    shared.destroy()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = np.flatnonzero(np.asarray(b.column("places").is_valid()))
            cover = {}
            if len(some):
                texts = b.column("text").take(pa.array(some))
                one, two, text, place = Words(texts).windows(size)
                ends = np.searchsorted(text, np.arange(len(some) + 1))
                for k, i in enumerate(some.tolist()):
                    here = slice(ends[k], ends[k + 1])
                    at = np.asarray(b.column("places")[i].values)
                    gone = np.flatnonzero(np.isin(one[here], one[here][at]) & np.isin(two[here], two[here][at]))
                    mark = np.zeros(len(one[here]) + size, np.int32)
                    mark[gone] += 1
                    mark[gone + size] -= 1
                    cover[i] = np.cumsum(mark)[:-1] > 0
            counts, lost, digests = [], [], []
            for i, t in enumerate(b.column("text")):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                counts.append(len(words))
                lost.append(int(cover[i].sum()) if i in cover else 0)
                left = compress(words, (~cover[i]).tolist()) if i in cover else words
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.record_batch({"doc_id": b.column("doc_id").cast(pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    of = removed.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "places")
    met = rows.join(of, rows["doc_id"].eqNullSafe(of["of_id"]) & (rows["text_hash"] == of["of_hash"]), "left").select("doc_id", "text", "places")
    return met.mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")

"""Packing token sequences into windows by the sum-of-squares rule."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> list[str]:
    """How byte-level models write bytes: printable Latin-1 as itself, the others in turn from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


_BYTES = _byte_letters()
#: Longer chunks are no words and aren't kept, which bounds a cache's memory.
LONGEST_KEPT = 64
_PLAIN_ENDS = ".,!?;:%&*#$|"


class WordCache(dict):
    """Token ids of white-space separated chunks as little-endian unsigned 32-bit bytes; forgets all beyond ``limit`` chunks.

    The tokenizer drops white space before it merges anything, so the ids of a text are those of its chunks in turn. It also
    lowers letters and merges runs of letters and of signs apart, so a chunk of Latin-1 letters with signs behind gets the ids of its
    lower-case letters and of the signs, which are kept as well; any other chunk goes to the tokenizer as it is.
    """

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}

    def _plain(self, piece: str) -> bytes:
        """Ids of one run of lower-case letters or of signs: the merges alone, on its bytes as the model writes them."""
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            text = "".join(map(_BYTES.__getitem__, piece.encode()))
            ids = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
            if len(piece) <= LONGEST_KEPT:
                self.pieces[piece] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        letters = chunk.rstrip(_PLAIN_ENDS)
        if letters.isalpha() and max(letters) < "\u0100":
            signs = chunk[len(letters) :]
            ids = self._plain(letters.lower()) + (self._plain(signs) if signs else b"")
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class SumOfSquaresPacker:
    """Online packing into windows of ``size`` tokens by the sum-of-squares rule.

    The fill of an open window belongs to one of ``size / step`` levels, and ``count`` holds the open windows of each. A piece of
    s tokens goes into a window for which the sum of squared counts is smallest afterwards: with counts N, moving a window from
    level a to b adds 2 (N[b] - N[a]) + 2, a new window at b 2 N[b] + 1, closing one 1 - 2 N[a]; staying on its level changes nothing.
    Ties go to the fullest window. A window with less than ``step`` tokens of room is closed.
    A document of more than ``size`` tokens gives whole windows first; the rule places the rest, never cut.

    The pieces of open windows are held back. With more than ``held`` open windows, and at the end, the emptiest are poured into what room the
    fullest have, cutting where needed, until half of them are left, or none; so windows are given out full, whatever the documents' lengths, and memory is bounded
    by ``held`` windows. The last window is cut into powers of two, which need no padding. ``moved`` counts the pieces that pouring gives another place.
    """

    def __init__(self, size: int, first_id: int, step: int = 32, held: int = 2048):
        self.size, self.next_id, self.step, self.most_held = size, first_id, step, held
        self.count = [0] * (size // step + 1)
        self.filled: list[int] = []  # levels with open windows, in order
        self.level: list[list[tuple[int, int]]] = [[] for _ in self.count]  # (fill, window), in order
        self.held: dict[int, list[tuple]] = {}
        self.placed = self.moved = 0

    def _piece(self, window: int, at: int, piece: tuple) -> tuple:
        doc, start, total, ids = piece
        self.placed += 1
        return doc, start, len(ids) // 4, zlib.crc32(ids), total, window, at

    def _pieces(self, window: int, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield self._piece(window, at, p)
            at += len(p[3]) // 4

    def _open(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _best(self, s: int) -> tuple[int, int] | None:
        """The open window ``(fill, id)`` that takes s tokens, taken out of its level, or none for a new one."""
        n, step, room = self.count, self.step, self.size - s
        best, spot, least = -1, 0, 2 * n[s // step] + 1
        if s > self.size - step:
            least = 0  # closed at once
        for a in self.filled[: bisect.bisect_right(self.filled, room // step)]:
            windows = self.level[a]
            k = bisect.bisect_right(windows, (room, self.next_id)) - 1  # the fullest with room
            below = bisect.bisect_left(windows, ((a + 1) * step - s % step, -1)) - 1  # the fullest that ends up a level lower
            for k in (below, k) if 0 <= below < k else (k,) if k >= 0 else ():
                fill = windows[k][0] + s
                b = fill // step
                cost = 1 - 2 * n[a] if fill > self.size - step else 0 if a == b else 2 * (n[b] - n[a]) + 2
                if cost <= least:
                    best, spot, least = a, k, cost
        if best < 0:
            return None
        n[best] -= 1
        if not n[best]:
            self.filled.remove(best)
        return self.level[best].pop(spot)

    def _keep(self, fill: int, window: int) -> None:
        a = fill // self.step
        if not self.count[a]:
            bisect.insort(self.filled, a)
        self.count[a] += 1
        bisect.insort(self.level[a], (fill, window))

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """The pieces that are settled once the tokens of a document are placed."""
        total, start, size = len(ids) // 4, 0, self.size
        while total - start >= size:
            yield self._piece(self._open(), 0, (doc, start, total, ids[4 * start : 4 * (start + size)]))
            start += size
        if start == total:
            return
        piece, found = (doc, start, total, ids[4 * start :]), self._best(total - start)
        fill, window = (0, self._open()) if found is None else found
        self.held.setdefault(window, []).append(piece)
        fill += total - start
        if fill <= size - self.step:
            self._keep(fill, window)
        else:
            yield from self._pieces(window, self.held.pop(window))
        if len(self.held) > self.most_held:
            yield from self._pour(self.most_held // 2)

    def _pour(self, left: int) -> Iterator[tuple]:
        """Fills the fullest windows with the pieces of the emptiest until at most ``left`` are open, or one if that is 0."""
        windows = [(fill, w) for level in self.level for fill, w in level]
        emptiest, fullest = 0, len(windows) - 1
        while emptiest < fullest and fullest - emptiest >= left:
            (fill, into), (rest, out) = windows[fullest], windows[emptiest]
            gap = self.size - fill
            while gap and self.held[out]:
                doc, start, total, ids = self.held[out].pop()
                cut = min(gap, len(ids) // 4)
                self.held[into].append((doc, start, total, ids[: 4 * cut]))
                self.moved += 1
                if 4 * cut < len(ids):
                    self.held[out].append((doc, start + cut, total, ids[4 * cut :]))
                gap, rest = gap - cut, rest - cut
            windows[fullest], windows[emptiest] = (self.size - gap, into), (rest, out)
            if not self.held[out]:
                del self.held[out]
                emptiest += 1
            if not gap:
                fullest -= 1
                yield from self._pieces(into, self.held.pop(into))
        self.filled, self.count, self.level = [], [0] * len(self.count), [[] for _ in self.count]
        for fill, window in windows[emptiest : fullest + 1]:
            if fill <= self.size - self.step:
                self._keep(fill, window)
            else:
                yield from self._pieces(window, self.held.pop(window))

    def finish(self) -> Iterator[tuple]:
        yield from self._pour(0)
        for pieces in self.held.values():  # one window at most
            left = sum(len(p[3]) // 4 for p in pieces)
            for size in [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]:
                part = []
                while size:
                    doc, start, total, ids = pieces.pop(0)
                    cut = min(size, len(ids) // 4)
                    part.append((doc, start, total, ids[: 4 * cut]))
                    if 4 * cut < len(ids):
                        pieces.insert(0, (doc, start + cut, total, ids[4 * cut :]))
                    size -= cut
                yield from self._pieces(self._open(), part)
        self.held, self.filled, self.count, self.level = {}, [], [0] * len(self.count), [[] for _ in self.count]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Packs ``docs(doc_id, text)``: one row per piece, see SCHEMA. Null text is empty, so a document has its end id at least.

    Every task packs the documents of its partition on its own, so nothing is shuffled; sequence ids hold the
    partition in their upper bits. A task's last window is cut into powers of two. Null and repeated
    doc_ids are packed row by row like any others, other columns are ignored, an empty table gives an empty table. Only one batch of
    texts and the pieces of a bounded number of open windows are in memory.
    """
    return docs.select("doc_id", "text").mapInPandas(packer(tokenizer_path, size, end_id), SCHEMA)


def packer(tokenizer_path: str, size: int, end_id: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, end = WordCache(tokenizer_path), np.array([end_id], "<u4").tobytes()
        packing = SumOfSquaresPacker(size, TaskContext.get().partitionId() << 40)
        for batch in batches:
            rows: list[tuple] = []
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            for doc, text in zip(ids, batch["text"], strict=True):
                rows += packing.add(doc, cache.encode(text or "") + end)
            yield frame(rows)
        yield frame(list(packing.finish()))

    return run

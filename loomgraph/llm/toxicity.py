"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, label_sample
from .quality import score_texts

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
BUCKETS = 1 << 17
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 0xA1, 0xAB, 0xB7, 0xBB, 0xBF, *range(0x2010, 0x2027)]))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SATURATED = 40.0


@dataclass
class Keys:
    """Hashes of several words: one for each word, and its n-grams from ``starts[i]`` to ``starts[i + 1]``."""

    words: np.ndarray
    grams: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Keys:
        """Keys of words: lower case, without punctuation around them, between < and >.

        The n-grams are all of four bytes, the first five and six bytes, and the whole word.
        """
        raw = np.frombuffer(("\n".join(f"<{x.strip(_EDGES) or x}>" for w in words for x in (w.lower(),)) + "\n").encode("utf-8", "replace"), np.uint8)
        stop = np.flatnonzero(raw == 10)
        start = np.concatenate([[0], stop[:-1] + 1])
        size = stop - start
        at = np.repeat(np.arange(len(words)), size + 1)
        place = np.arange(len(raw)) - start[at]
        powers = np.multiply.accumulate(np.full(int(size.max()) + 1, _PRIME))
        big = raw.astype(np.uint64) + np.uint64(1)
        whole = np.add.reduceat(big * powers[place] * (raw != 10), start)
        found = [(np.arange(len(words)), whole)]
        for n, only_first in ((4, False), (5, True), (6, True)):
            i = start[size >= n] if only_first else np.flatnonzero(place + n <= size[at])
            h = np.full(len(i), n, np.uint64)
            for k in range(n):
                h = h * _PRIME + big[i + k]
            found.append((at[i], h))
        owner, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(owner, kind="stable")
        fold = lambda h: (((h ^ (h >> np.uint64(32))) * _PRIME) >> np.uint64(40)).astype(np.int64) % BUCKETS
        return Keys(fold(whole + np.uint64(1)), fold(hashes[order]), np.searchsorted(owner[order], np.arange(len(words) + 1)))

    def take(self, i: np.ndarray) -> Keys:
        n = np.diff(self.starts)[i]
        starts = np.concatenate([[0], np.cumsum(n)])
        return Keys(self.words[i], self.grams[np.arange(starts[-1]) - np.repeat(starts[:-1] - self.starts[i], n)], starts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class BiGru:
    """Parameters: embeddings of hashed words and character n-grams, two GRUs, attention, output, and the scale of document scores.

    The gates are update, reset and candidate, ``h = z h + (1 - z) tanh(n + r (U h))``. ``p`` maps names to float32 arrays.
    """

    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    empty: float = 0.0

    @staticmethod
    def start(seed: int) -> BiGru:
        rng = np.random.default_rng(seed)
        e, h = WORD_DIM + CHAR_DIM, HIDDEN
        r = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
        p = {"word": r(BUCKETS, WORD_DIM, k=0.05), "char": r(BUCKETS, CHAR_DIM, k=0.05)}
        for d in "fb":
            p |= {f"W{d}": r(e, 3 * h), f"b{d}": np.zeros(3 * h, np.float32), f"U{d}": r(h, 3 * h)}
        return BiGru(p | {"A": r(2 * h, ATTENTION), "a": r(ATTENTION), "o": r(2 * h), "c": np.zeros(1, np.float32)})

    def inputs(self, keys: Keys) -> np.ndarray:
        """Word vector and mean character n-gram vector, side by side."""
        grams = np.add.reduceat(self.p["char"][keys.grams], keys.starts[:-1], 0) / np.diff(keys.starts)[:, None]
        return np.concatenate([self.p["word"][keys.words], grams], 1).astype(np.float32)


def _steps(px: np.ndarray, u: np.ndarray, order: range) -> tuple[np.ndarray, list]:
    """Runs one direction over px (steps, n, 3h); hidden states by step, and what the gradient needs."""
    h = np.zeros((px.shape[1], HIDDEN), np.float32)
    states, kept = np.empty((len(order), px.shape[1], HIDDEN), np.float32), []
    for t in order:
        g = h @ u
        z, r = _sigmoid(px[t, :, :HIDDEN] + g[:, :HIDDEN]), _sigmoid(px[t, :, HIDDEN : 2 * HIDDEN] + g[:, HIDDEN : 2 * HIDDEN])
        n = np.tanh(px[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        kept.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
        h = z * h + (1 - z) * n
        states[t] = h
    return states, kept


def _steps_back(d_states: np.ndarray, kept: list, u: np.ndarray, d_px: np.ndarray) -> np.ndarray:
    d_u, d_h = np.zeros_like(u), np.zeros_like(d_states[0])
    for t, h, z, r, n, gn in reversed(kept):
        d_h = d_h + d_states[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z, d_r = d_h * (h - n) * z * (1 - z), d_n * gn * r * (1 - r)
        d_px[t] = np.concatenate([d_z, d_r, d_n], 1)
        d_g = np.concatenate([d_z, d_r, d_n * r], 1)
        d_u += h.T @ d_g
        d_h = d_h * z + d_g @ u.T
    return d_u


def window_logits(m: BiGru, x: np.ndarray, pad: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, dict | None]:
    """Logits of windows x (steps, n, inputs) with padding marks (steps, n); with labels y also the gradients of the mean log loss."""
    p, grads = m.p, None
    hs, kept = {}, {}
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        px = x @ p[f"W{d}"] + p[f"b{d}"]
        px[pad, :HIDDEN] = _SATURATED  # a padded step keeps the state
        hs[d], kept[d] = _steps(px, p[f"U{d}"], order)
    h = np.concatenate([hs["f"], hs["b"]], 2)
    u = np.tanh(h @ p["A"])
    s = np.where(pad, -1e9, u @ p["a"])
    w = np.exp(s - s.max(0))
    w /= w.sum(0)
    pooled = (w[..., None] * h).sum(0)
    logit = pooled @ p["o"] + p["c"]
    if y is not None:
        d_l = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        d_pool = d_l[:, None] * p["o"]
        d_w = (h * d_pool).sum(2)
        d_s = w * (d_w - (w * d_w).sum(0))
        d_u = d_s[..., None] * p["a"] * (1 - u * u)
        d_h = w[..., None] * d_pool + d_u @ p["A"].T
        flat = lambda a: a.reshape(-1, a.shape[-1])
        grads = {"o": pooled.T @ d_l, "c": d_l.sum(keepdims=True), "a": flat(u).T @ d_s.ravel(), "A": flat(h).T @ flat(d_u), "x": np.zeros_like(x)}
        for k, d in enumerate("fb"):
            d_px = np.zeros((*x.shape[:2], 3 * HIDDEN), np.float32)
            grads[f"U{d}"] = _steps_back(d_h[:, :, k * HIDDEN : (k + 1) * HIDDEN], kept[d], p[f"U{d}"], d_px)
            d_px[pad] = 0
            grads[f"W{d}"], grads[f"b{d}"] = flat(x).T @ flat(d_px), flat(d_px).sum(0)
            grads["x"] += d_px @ p[f"W{d}"].T
    return logit, grads


class WindowScorer:
    """Scores all overlapping windows of texts. Projected inputs are kept for each distinct word, at most ``limit`` of them.

    Texts are laid out in blocks of STRIDE tokens, each text followed by a block of padding, so a window is two blocks in
    succession and step t of all windows is one contiguous slice.
    """

    def __init__(self, model: BiGru, limit: int = 120_000, tokens: int = 1 << 15):
        self.m, self.limit, self.tokens = model, limit, tokens
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, 6 * HIDDEN), np.float32)
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        pad = np.zeros(6 * HIDDEN, np.float32)
        pad[:HIDDEN] = pad[3 * HIDDEN : 4 * HIDDEN] = _SATURATED
        self.rows[0], self.used, self.kept = pad, 1, 0

    def _ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.int32)
        except KeyError:
            new = list(dict.fromkeys(w for w in words if w not in known))
        if self.used + len(new) > self.limit or self.kept > 64 * self.limit:
            self._clear()
            new = list(dict.fromkeys(words))
        x, p = self.m.inputs(Keys.of(new)), self.m.p
        while self.used + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used : self.used + len(new)] = np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], 1)
        for w in new:
            known[w] = self.used
            self.used += 1
            self.kept += len(w)
        return np.array([known[w] for w in words], np.int32)

    def logits(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the logits of its windows; none for a text without words."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            words = text.split()
            # a very long text goes in slices that share one block, so that no window is lost and memory stays bounded
            for at in range(0, max(1, len(words) - STRIDE), self.tokens - STRIDE):
                if part := words[at : at + self.tokens]:
                    group.append((i, part))
                    size += len(part)
                if size >= self.tokens:
                    self._flush(group, out)
                    group, size = [], 0
        self._flush(group, out)
        return [np.concatenate(x) if x else np.zeros(0, np.float32) for x in out]

    def _flush(self, group: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        if not group:
            return
        ids = self._ids([w for _, part in group for w in part])
        # block by block: each text's tokens, padding up to a whole block, and one block of padding
        spans = np.array([len(part) for _, part in group])
        whole = -(-spans // STRIDE)
        first = np.concatenate([[0], np.cumsum(whole + 1)])
        blocks = int(first[-1])
        row = np.zeros(blocks * STRIDE, np.int32)
        row[np.arange(len(ids)) + np.repeat(first[:-1] * STRIDE - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans)] = ids
        by_step = np.ascontiguousarray(self.rows[row.reshape(blocks, STRIDE).T].transpose(0, 2, 1))
        logit = self._run(by_step, np.ascontiguousarray((row == 0).reshape(blocks, STRIDE).T), blocks - 1)
        for (i, _), k, n in zip(group, first, whole, strict=False):
            out[i].append(logit[k : k + max(1, n - 1)])

    def _run(self, x: np.ndarray, pad: np.ndarray, n: int) -> np.ndarray:
        p, h2 = self.m.p, 2 * HIDDEN
        states = np.empty((WINDOW, h2, n), np.float32)
        for d, order in enumerate((range(WINDOW), range(WINDOW - 1, -1, -1))):
            u, h = np.ascontiguousarray(p["Uf" if d == 0 else "Ub"].T), np.zeros((HIDDEN, n), np.float32)
            lo = d * 3 * HIDDEN
            for t in order:
                px = x[t % STRIDE, lo : lo + 3 * HIDDEN, t // STRIDE : t // STRIDE + n]
                g = u @ h
                zr = g[:h2]
                zr += px[:h2]
                np.tanh(np.multiply(zr, 0.5, out=zr), out=zr)  # the logistic function by tanh
                zr *= 0.5
                zr += 0.5
                c = g[h2:]
                c *= zr[HIDDEN:]
                c += px[h2:]
                np.tanh(c, out=c)
                h = zr[:HIDDEN] * (h - c)
                h += c
                states[t, d * HIDDEN : (d + 1) * HIDDEN] = h
        total, peak = np.zeros(n, np.float32), np.full(n, -1e9, np.float32)
        pooled, a_t = np.zeros((h2, n), np.float32), np.ascontiguousarray(p["A"].T)
        scores = np.empty((WINDOW, n), np.float32)
        for t in range(WINDOW):
            scores[t] = p["a"] @ np.tanh(a_t @ states[t])
            scores[t][pad[t % STRIDE, t // STRIDE : t // STRIDE + n]] = -1e9
        peak = scores.max(0)
        for t in range(WINDOW):
            w = np.exp(scores[t] - peak)
            total += w
            pooled += w * states[t]
        return p["o"] @ (pooled / total) + p["c"]

    def score(self, texts: list[str]) -> list[float]:
        """The probability of label 1, from the highest window; the share of label 1 for a text without words."""
        return [float(_sigmoid(self.m.slope * z.max() + self.m.shift)) if len(z) else self.m.empty for z in self.logits(texts)]


def _log_odds(docs: list[np.ndarray], y: np.ndarray, least: float = 3.0) -> np.ndarray:
    """For each hash value: smoothed log odds of label 1 by the documents that hold it, 0 where below 0 or seldom seen."""
    counts = np.zeros((2, BUCKETS), np.float32)
    for d, label in zip(docs, y, strict=True):
        counts[label, np.unique(d)] += 1
    n = np.array([max(1, (y == v).sum()) for v in (0, 1)], np.float32)
    odds = np.log((counts[1] / n[1] + 0.5 / n[1]) / (counts[0] / n[0] + 0.5 / n[1]))
    return np.maximum(odds, 0) * np.minimum(1, counts[1] / least)


def _threshold(top: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit with the least weighted error, in the middle of its gap."""
    order = np.argsort(top)
    z, w1, w0 = top[order], (weight * y)[order], (weight * (1 - y))[order]
    missed = np.concatenate([[0], np.cumsum(w1)])
    false = np.concatenate([np.cumsum(w0[::-1])[::-1], [0]])
    k = np.flatnonzero((cost := missed + false) <= cost.min() + 1e-9)
    edge = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    best = k[np.argmax(edge[k + 1] - edge[k])]
    return float((edge[best] + edge[best + 1]) / 2)


def fit_bigru(
    texts: list[str], labels: list[int], share: float, rounds: int = 4, epochs: int = 2, batch: int = 128, rate: float = 0.02, per_text: int = 2, seed: int = 11, odds: bool = True, unseen: float = 0.5, slow: float = 0.3
) -> BiGru:
    """Trains on windows: of a document with label 1 the ones whose words lean most to label 1, of others the hardest and random ones.

    Windows are chosen by the log odds of words and n-grams on the same rows, which with ``odds`` also start one dimension of each
    embedding. In later rounds the highest windows by the network itself join them. In each batch a share ``unseen`` of the words
    loses its own vector, as words of new texts have none, so that their n-grams must tell. Adagrad, embeddings at ``slow`` times the rate. The logit at which a document's highest window counts as label 1 is the one
    with the least error on all windows of the rows, weighted so that ``share`` of the rows has label 1. With labels of
    one kind only every score is the share.
    """
    m = BiGru.start(seed)
    m.empty = float(share)
    y_docs = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        m.slope, m.shift = 0.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return m
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.split()], np.int64) for t in texts]
    keys = Keys.of(list(vocabulary))
    unique = [np.unique(d) for d in docs]
    word_odds, char_odds = _log_odds([keys.words[u] for u in unique], y_docs), _log_odds([keys.take(u).grams for u in unique], y_docs)
    if odds:
        m.p["word"][:, 0], m.p["char"][:, 0] = word_odds / 2, char_odds / 2
    lean = np.maximum(word_odds[keys.words], np.add.reduceat(char_odds[keys.grams], keys.starts[:-1]) / np.diff(keys.starts))
    starts = [np.arange(0, max(1, len(d) - STRIDE), STRIDE) for d in docs]
    lists: set[tuple[int, int]] = set()

    def choose(values: list[np.ndarray], first: bool) -> None:
        for i, (v, label) in enumerate(zip(values, y_docs, strict=True)):
            if len(docs[i]):
                best = np.argsort(-v)[:per_text]
                best = best[:1] if label and not first else best[v[best] >= 0.7 * v[best[0]]] if label else best
                more = [] if label else rng.integers(0, len(v), 1 if first else 0)
                lists.update((i, int(s)) for s in starts[i][np.concatenate([best, more]).astype(int)])

    choose([np.array([np.sort(lean[d[s : s + WINDOW]])[-3:].sum() for s in at]) for d, at in zip(docs, starts, strict=True)], True)
    total = {k: np.full_like(v, 1e-6) for k, v in m.p.items()}

    def descend(k: str, g: np.ndarray, at: np.ndarray | slice, step: float) -> None:
        total[k][at] += g * g
        m.p[k][at] -= step * g / np.sqrt(total[k][at])

    # one word over and over, from documents with label 0: drives states where running text never takes them
    plain = np.unique(np.concatenate([d for d, label in zip(docs, y_docs, strict=True) if not label]))
    repeated = np.repeat(rng.choice(plain, min(len(plain), len(docs) // 3))[:, None], WINDOW, 1) if len(plain) else np.zeros((0, WINDOW), np.int64)

    def epoch() -> None:
        spots = sorted(lists)
        index = np.stack([np.pad(docs[i][s : s + WINDOW], (0, max(0, s + WINDOW - len(docs[i]))), constant_values=-1) for i, s in spots])
        index = np.concatenate([index, repeated])
        y = np.concatenate([y_docs[[i for i, _ in spots]], np.zeros(len(repeated))]).astype(np.float32)
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            ids, where = np.unique(index[at], return_inverse=True)
            where = where.reshape(index[at].shape).T
            pad = index[at].T < 0
            own = keys.take(np.maximum(ids, 0))
            x_all = m.inputs(own)
            known = rng.random(len(ids)) >= unseen
            x_all[:, :WORD_DIM] *= known[:, None]
            x = x_all[where]
            x[pad] = 0
            _, g = window_logits(m, x, pad, y[at])
            flat = where[~pad]
            g_x = g.pop("x")[~pad]
            d_x = np.stack([np.bincount(flat, g_x[:, k], len(ids)) for k in range(g_x.shape[1])], 1).astype(np.float32)
            for k, v in g.items():
                descend(k, v, slice(None), rate)
            n = np.diff(own.starts)
            for k, hashes, d in (("word", own.words, d_x[:, :WORD_DIM] * known[:, None]), ("char", own.grams, np.repeat(d_x[:, WORD_DIM:] / n[:, None], n, 0))):
                u, back = np.unique(hashes, return_inverse=True)
                descend(k, np.stack([np.bincount(back, d[:, j], len(u)) for j in range(d.shape[1])], 1).astype(np.float32), u, rate * slow)
    for k in range(rounds):
        if k:  # the windows that the network itself finds highest, right or wrong
            choose(WindowScorer(m).logits(texts), False)
        for _ in range(max(epochs, min(20, 60 * batch // len(lists)))):
            epoch()
    top = np.array([z.max() if len(z) else -9.0 for z in WindowScorer(m).logits(texts)])
    weight = np.where(y_docs == 1, share / (y_docs == 1).mean(), (1 - share) / (y_docs == 0).mean())
    m.shift = -_threshold(top, y_docs, weight)
    return m


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1000, max_chars: int = 20_000) -> BiGru:
    """Fits on labelled rows whose crc32(doc_id) mod 5 isn't 0: at most ``per_class`` of either label, texts of at most ``max_chars``.

    A task fits on this bounded sample, so that neither its texts nor the training's arrays are in the driver, which gets the model alone.
    """
    keep = id_crc() % 5 != 0
    share = float(labels.where(keep & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0] or 0.0)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := list(batches):
            rows = pd.concat(parts, ignore_index=True).sort_values("doc_id")
            yield pd.DataFrame({"model": [pickle.dumps(fit_bigru(rows["text"].tolist(), rows["y"].tolist(), share))]})

    fitted = label_sample(docs, labels, label, keep, per_class, max_chars).repartition(1).mapInPandas(fit, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else fit_bigru([], [], share)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document: the highest of all overlapping windows of the whole text.

    Null and empty texts score the share of label 1. Null doc_ids are scored like others and count as not held out; repeated rows
    give repeated results; other columns are ignored. An empty table gives an empty table. The model has a fixed size and is
    broadcast; texts go through in batches of bounded size, however long they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, **fit))

    def make() -> Callable[[list[str]], list[float]]:
        return WindowScorer(model.value).score

    held_out = F.col("doc_id").isNotNull() & (id_crc() % 5 == 0)
    return score_texts(docs, make).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit) -> DataFrame:
    """The rows of ``docs`` with all their columns whose score is below the threshold; rows without words stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, **fit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WindowScorer(model.value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([not t.strip() or s < threshold for t, s in zip(texts, scorer.score(texts), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

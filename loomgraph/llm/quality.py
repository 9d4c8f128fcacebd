"""Quality classifier: hashed word n-gram logistic regression fitted by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, label_sample

_RUN = re.compile(r"(.)\1+", re.S)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs of one class as one; other characters stay themselves."""
    return _RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


class NgramHasher:
    """Hash values of texts: n-grams of one to three words, and n-grams of one to three word shapes.

    Words count in lower case. Words and shapes get their hashes once, kept for at most ``limit`` words. A value of a feature is ``SCALE`` times the share it
    has among the n-grams of its kind, so vectors of texts of any length are of one size. One more feature tells the share of words that
    were seen before in the text. A text without words has one feature of its own.
    """

    SCALE = 8.0

    def __init__(self, bits: int = 18, limit: int = 120_000):
        self.mask, self.limit = np.uint64((1 << bits) - 1), limit
        self.table = np.zeros((1 << 12, 2), np.uint64)
        self.words: dict[str, int] = {}
        self.kept = 0  # characters of the words

    def _numbers(self, words: list[str]) -> np.ndarray:
        known = self.words
        try:
            return np.array([known[w] for w in words], np.int32)
        except KeyError:
            new = list(dict.fromkeys(w for w in words if w not in known))
        if len(known) + len(new) > self.limit or self.kept > 64 * self.limit:
            known.clear()
            self.kept = 0
            new = list(dict.fromkeys(words))
        while len(known) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for w in new:
            self.table[len(known)] = xxhash.xxh64_intdigest("w" + w.lower()), xxhash.xxh64_intdigest("s" + word_shape(w))
            known[w] = len(known)
            self.kept += len(w)
        return np.array([known[w] for w in words], np.int32)

    def __call__(self, text: str) -> list[np.ndarray]:
        """Hash values by kind, with repeats."""
        words = text.split()
        if not words:
            return [np.zeros(1, np.int64)]
        numbers = self._numbers(words)
        kinds = []
        for h in (self.table[numbers, 0], self.table[numbers, 1]):
            kinds.append(h)
            if len(h) > 1:
                kinds.append(two := h[:-1] * _MIX + h[1:])
            if len(h) > 2:
                kinds.append((two[:-1] ^ (two[:-1] >> np.uint64(29))) * _MIX + h[2:])
        again = int(10 * (1 - len(set(words)) / len(words)))
        kinds.append(np.array([(again * 8 + min(7, len(words).bit_length() // 2) + 1) << 44], np.uint64))
        return [((((h ^ (h >> np.uint64(32))) * _MIX) >> np.uint64(40)) & self.mask).astype(np.int64) for h in kinds]

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The sparse vector: distinct hash values and their values."""
        kinds = self(text)
        u, back = np.unique(np.concatenate(kinds), return_inverse=True)
        return u, np.bincount(back, np.concatenate([np.full(len(k), self.SCALE / len(k)) for k in kinds]))


@dataclass
class FtrlModel:
    """Weights and bias; ``score`` is the probability of label 1."""

    weights: np.ndarray
    bias: float
    bits: int

    def score(self, kinds: list[np.ndarray]) -> float:
        """The dot product of weights and the vector of these hash values, through the logistic function."""
        dot = NgramHasher.SCALE * sum(float(self.weights[k].mean()) for k in kinds)
        return float(1 / (1 + np.exp(-np.clip(dot + self.bias, -30, 30))))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int = 18, passes: int = 4, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 7) -> FtrlModel:
    """FTRL-Proximal with a learning rate for each coordinate. Without labels of both kinds the score is their share everywhere."""
    n, z = np.zeros(1 << bits), np.zeros(1 << bits)
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    bias, bias_n = float(np.log(share / (1 - share))), 0.0
    if 0 < sum(labels) < len(labels):
        rng = np.random.default_rng(seed)
        for _ in range(passes):
            for i in rng.permutation(len(labels)):
                keys, values = rows[i]
                zi, ni = z[keys], n[keys]
                w = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
                error = 1 / (1 + np.exp(-np.clip(w @ values + bias, -30, 30))) - labels[i]
                g = error * values
                z[keys] += (g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w)
                n[keys] += g * g
                bias_n += error * error
                bias -= alpha * error / (beta + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return FtrlModel(w.astype(np.float32), bias, bits)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000, max_chars: int = 20_000, bits: int = 18) -> FtrlModel:
    """Fits on labelled rows whose crc32(doc_id) mod 4 isn't 2: at most ``per_class`` of either label, texts of at most ``max_chars``."""
    sample = label_sample(docs, labels, label, id_crc() % 4 != 2, per_class, max_chars).toPandas().sort_values("doc_id")
    hasher = NgramHasher(bits)
    return fit_ftrl([hasher.vector(t) for t in sample["text"]], sample["y"].tolist(), bits)


def score_texts(docs: DataFrame, make_scorer: Callable[[], Callable[[list[str]], list[float]]]) -> DataFrame:
    """Adds nothing but ``(doc_id, score)``: texts in batches through a scorer that each task makes once; null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": scorer([t or "" for t in b["text"]])})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document; whole texts, any length.

    The model (one float for each of ``2 ** bits`` hash values) is broadcast. Null and empty texts get the score that the model gives
    to a text without words; null doc_ids are scored like others and count as not held out; repeated rows give repeated
    results; other columns are ignored. An empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, **fit))

    def make() -> Callable[[list[str]], list[float]]:
        m = model.value
        hasher = NgramHasher(m.bits)
        return lambda texts: [m.score(hasher(t)) for t in texts]

    held_out = F.col("doc_id").isNotNull() & (id_crc() % 4 == 2)
    return score_texts(docs, make).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

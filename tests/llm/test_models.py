"""The trained models against plain versions of the same steps."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import xxhash

from loomgraph.llm import quality, toxicity

_ALL = (1 << 64) - 1
_K = 0x9E3779B97F4A7C15


def _vector(text, bits):
    """Word and shape n-grams of a text, one by one, in whole numbers."""
    words = text.split()
    if not words:
        return {0: quality.NgramHasher.SCALE}
    out = Counter()

    def add(hashes):
        for h in hashes:
            out[(((h ^ h >> 32) * _K & _ALL) >> 40) & ((1 << bits) - 1)] += quality.NgramHasher.SCALE / len(hashes)

    for one in ([xxhash.xxh64_intdigest("w" + w.lower()) for w in words], [xxhash.xxh64_intdigest("s" + quality.word_shape(w)) for w in words]):
        add(one)
        two = [(a * _K + b) & _ALL for a, b in zip(one, one[1:], strict=False)]
        if two:
            add(two)
        three = [((x ^ x >> 29) * _K + c) & _ALL for x, c in zip(two, one[2:], strict=False)]
        if three:
            add(three)
    again = int(10 * (1 - len(set(words)) / len(words)))
    add([(again * 8 + min(7, len(words).bit_length() // 2) + 1) << 44])
    return out


TEXTS = ["", "one", "one two", "A b a B a b a b C.", "x1 x1 x2 – é É " * 9, "the cat sat", "cat the sat", "Sat THE 99 cat!"]


def test_quality_vector_holds_word_ngrams():
    hasher = quality.NgramHasher(16, limit=5)
    for text in [*TEXTS, *TEXTS[::-1]]:
        keys, values = hasher.vector(text)
        want = _vector(text, 16)
        assert dict(zip(keys.tolist(), values.round(9).tolist(), strict=True)) == {k: round(v, 9) for k, v in want.items()}
    # the same words in another order differ, so phrases count
    assert _vector(TEXTS[5], 16).keys() != _vector(TEXTS[6], 16).keys()


def test_quality_fit_follows_the_regularised_leader():
    bits, labels = 12, [1, 0, 1, 1, 0, 1, 0, 0]
    rows = [quality.NgramHasher(bits).vector(t) for t in TEXTS]
    got = quality.fit_ftrl(rows, labels, bits, passes=3, alpha=0.3, beta=0.7, l1=0.05, l2=0.4, seed=9)
    z, n, bias, bias_n = Counter(), Counter(), math.log(4.5 / 4.5), 0.0

    def weight(k):
        return 0.0 if abs(z[k]) <= 0.05 else -(z[k] - math.copysign(0.05, z[k])) / ((0.7 + math.sqrt(n[k])) / 0.3 + 0.4)

    rng = np.random.default_rng(9)
    for _ in range(3):
        for i in rng.permutation(len(labels)):
            x = _vector(TEXTS[i], bits)
            w = {k: weight(k) for k in x}
            error = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items()) - bias)) - labels[i]
            for k, v in x.items():
                g = error * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.3 * w[k]
                n[k] += g * g
            bias_n += error * error
            bias -= 0.3 * error / (0.7 + math.sqrt(bias_n))
    assert abs(got.bias - bias) < 1e-9 and np.flatnonzero(got.weights).tolist() == sorted(k for k in n if weight(k))
    assert all(abs(got.weights[k] - weight(k)) < 1e-6 for k in n)
    for text in TEXTS:
        plain = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in _vector(text, bits).items()) - bias))
        assert abs(got.score(quality.NgramHasher(bits)(text)) - plain) < 1e-5


def _rude(n, seed):
    """Texts with label 1 hold words that start alike and that no other text holds: only n-grams can tell."""
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    texts = []
    for k in range(n):
        w = list(rng.choice(plain, int(rng.integers(20, 90))))
        if k % 3 == 0:
            for at in rng.choice(len(w), 4, replace=False):
                w[at] = "zorq" + "".join(rng.choice(list("abcdefgh"), 4))
        texts.append(" ".join(w))
    return texts, [int(k % 3 == 0) for k in range(n)]


def test_toxicity_network_learns_by_itself():
    (texts, labels), (others, truth) = _rude(240, 1), _rude(120, 2)
    for odds in (True, False):
        m = toxicity.fit_bigru(texts, labels, 1 / 3, odds=odds, slow=1.0)
        found = np.array(toxicity.WindowScorer(m).score(others)) >= 0.5
        assert (found == np.array(truth, bool)).mean() > 0.95, odds
        again = toxicity.fit_bigru(texts, labels, 1 / 3, odds=odds, slow=1.0)
        assert all((m.p[k] == again.p[k]).all() for k in m.p) and m.shift == again.shift

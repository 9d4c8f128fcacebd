"""Repeated passages against sets of word tuples, and the parts of the count-min sketch."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import repeats

SCHEMA = "doc_id long, text string, text_hash long, place int, one long, n_words long"


def _plain(docs, size=13):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in words:
        if d is not None:
            for k in range(len(w) - size + 1):
                at = tuple(w[k : k + size])
                first[at] = min(first.get(at, d), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            least = first.get(tuple(w[k : k + size]))
            if least is not None and (d is None or least < d):
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def _got(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in frame.collect()), key=str)


@pytest.mark.parametrize("cells", [64, 1 << 28])
def test_odd_documents(spark, cells):
    """With a sketch so small that it lets everything through as well."""
    rng = random.Random(13)
    passages = [" ".join(f"p{j}_{k}" for k in range(60)) for j in range(4)]
    docs = [(None, passages[0]), (None, passages[0]), (None, "own " * 5), (3, None), (4, ""), (5, " \t\n"), (6, "word " * 5000), (6, "word " * 20), (9, "word " * 30), (7, "x" * 100_000), (8, "é\x1c\x85 ü " * 20), (8, "é\x1c\x85 ü " * 20), (10, "é\x1c\x85 ü " * 20)]
    for k in range(120):
        own = [f"d{k}_{j}" for j in range(rng.randrange(40))]
        at = rng.randrange(len(own) + 1)
        cut = passages[k % 4].split()[rng.randrange(20) : 30 + rng.randrange(30)]
        docs.append((20 + k % 90, rng.choice([" ", "\n", "  \t"]).join(own[:at] + cut + own[at:])))
    docs += [(1000 + k, passages[3] + " tail") for k in range(80)]
    df = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in docs], SCHEMA).repartition(6)
    assert _got(repeats.without_repeats(df, most_cells=cells)) == _plain(docs)
    assert repeats.without_repeats(df.limit(0)).count() == 0
    short = df.where("doc_id IN (3, 4, 5)")
    assert _got(repeats.without_repeats(short)) == _plain([x for x in docs if x[0] in (3, 4, 5)])


def test_words_are_those_of_the_bytes():
    texts = ["a b  c\td", " x", "", None, "é   q\x1cz  " + "w" * 20 + " " + "v" * 700 + "\x0b" + "v" * 699, "end", "a\x85b　c", "v" * 700]
    words = repeats.Words(pa.array(texts))
    plain = [(t or "").encode().split() for t in texts]
    assert np.diff(words.first).tolist() == list(map(len, plain))
    flat = [w for p in plain for w in p]
    one, two = words.hashes
    for h in (one, two):
        assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
    rng = random.Random(2)
    many = list({"".join(rng.choices("ab\x00é", k=rng.randrange(1, 30))) for _ in range(20_000)})
    many = [w for w in many if not w.isspace()]
    assert all(len(np.unique(h)) == len(many) for h in repeats.Words(pa.array(many)).hashes)


def test_estimates_are_never_too_small():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 5000, np.uint64)
    shown = np.concatenate([keys, keys[:700], keys[:100]])
    sketch = repeats.CountMin(1 << 14, slab=1 << 10)
    counts = np.zeros((sketch.rows, sketch.cells), np.uint8)
    for part in np.array_split(shown, 7):
        for r in sketch.partial(part).to_pylist():
            sketch.add(counts[r["row"], r["slab"] * sketch.slab :][: sketch.slab], r["cells"])
    for row in range(sketch.rows):
        assert (counts[row] == np.minimum(np.bincount(sketch.cell(row, shown), minlength=sketch.cells), 255)).all()
    may = sketch.may_repeat(np.packbits(counts >= 2, axis=1), keys)
    assert set(range(700)) <= set(may.tolist()) and len(may) < 3000
    many = np.repeat(keys[:1], 1000)
    sketch.add(one := np.zeros(sketch.slab, np.uint8), next(r["cells"] for r in sketch.partial(many).to_pylist() if r["row"] == 0))
    assert one.max() == 255

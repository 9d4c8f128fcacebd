"""Near duplicates of known similarity, just above the threshold."""

from __future__ import annotations

import numpy as np

from loomgraph.llm import setsketch


def test_pairs_between_085_and_090_are_linked(spark):
    rng = np.random.default_rng(88)
    docs = []

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    while len(docs) < 2000:
        n, k = int(rng.integers(60, 400)), len(docs)
        one = [f"w{x}" for x in rng.integers(0, 50_000, n)]
        two = list(one)
        for j in rng.choice(n, max(1, round(n * rng.uniform(0.014, 0.03))), replace=False):
            two[j] = f"c{k}_{j}"
        a, b = shingles(one), shingles(two)
        if 0.85 <= len(a & b) / len(a | b) < 0.90:
            docs += [(k, " ".join(one)), (k + 1, " ".join(two))]
    got = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()}
    assert got == {k: k - k % 2 for k in range(2000)}

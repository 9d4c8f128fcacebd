from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from loomgraph.operators import graph


def _reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.insert(0, b)
        todo.pop()
    return seen


def test_components_and_witnesses(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(22)})
    e = spark.createDataFrame([x for x in edges if x[0] != x[1]], "src long, dst long")
    reach = {k: _reach(edges, k) for k in range(14)}
    want = {k: min(j for j in range(14) if j == k or j in reach[k] and k in reach[j]) for k in range(14) if any(j != k and j in reach[k] and k in reach[j] for j in range(14))}
    found = graph.strong_components(e)
    assert {r["id"]: r["component"] for r in found.collect()} == want
    for r in graph.cycle_witnesses(e, found).collect():
        c = r["cycle"]
        assert c[0] == c[-1] == r["component"] and len(c) > 2 and all(p in edges for p in zip(c, c[1:], strict=False))


def test_pagerank_keeps_mass(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0), (3, 9)], "src long, dst long")
    r = graph.pagerank(spark.range(5), e, iterations=5).collect()
    assert abs(sum(x["rank"] for x in r) - 1) < 1e-9 and len(r) == 5


def _plain_ranks(n, pairs, iterations, damping=0.85):
    known = {(a, b) for a, b in pairs if a < n and b < n}
    degree = [sum(1 for a, _ in known if a == k) for k in range(n)]
    rank = [1 / n] * n
    for _ in range(iterations):
        lost = sum(r for r, d in zip(rank, degree, strict=True) if not d)
        rank = [(1 - damping) / n + damping * (sum(rank[a] / degree[a] for a, b in known if b == k) + lost / n) for k in range(n)]
    return rank


@pytest.mark.parametrize("most_links", [None, 2])
def test_pagerank_against_a_plain_version(spark, most_links):
    """With a hub, by buckets of whole sources and by salted ones."""
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(40)} | {(7, k) for k in range(29)} | {(k, 3) for k in range(20)})
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["id"]: r["rank"] for r in graph.pagerank(spark.range(28), e, iterations=7, stride=3, most_links=most_links).collect()}
    want = _plain_ranks(28, pairs, 7)
    assert len(got) == 28 and all(abs(got[k] - want[k]) < 1e-12 for k in range(28))


def test_an_iteration_shuffles_its_messages_alone(spark, monkeypatch):
    """Four iterations and what starts them: a shuffle of the messages each, one of the first power; the links stay where they are."""
    plans = []

    def kept(df, name, write=graph.written):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(graph, "written", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        e = spark.createDataFrame([(k, (k * 7 + 3) % 50) for k in range(50)], "src long, dst long")
        graph.pagerank(spark.range(50), e, iterations=4, stride=4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    (plan,) = [p for name, p in plans if name == "powers"]
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert len(shuffles) == 5 and "Bucketed: true" in plan
    assert not any("SinglePartition" in p for _, p in plans)


@pytest.mark.parametrize(("seed", "chunk"), [(1, 4), (2, 1000)])
def test_strong_components_against_a_plain_version(spark, seed, chunk):
    """Over many small chunks, which leave much to colouring, and over few."""
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(40)} | {(40 + k, 40 + (k + 1) % 7) for k in range(7)})
    e = spark.createDataFrame(pairs, "src long, dst long")
    want = {}
    reach = {k: _reach(pairs, k) for k in range(60)}
    for k in range(60):
        inside = [j for j in reach[k] if j != k and k in reach[j]]
        if inside:
            want[k] = min(k, *inside)
    found = graph.strong_components(e, most=chunk, least=chunk)
    assert {r["id"]: r["component"] for r in found.collect()} == want
    coloured = graph._coloured(e.where("src <> dst"), len(pairs))
    got = {}
    for r in coloured.collect():
        got.setdefault(r["component"], set()).add(r["id"])
    assert {frozenset(v) for v in got.values() if len(v) > 1} == {frozenset(k for k in want if want[k] == c) for c in set(want.values())}
    cycles = {r["component"]: r["cycle"] for r in graph.cycle_witnesses(e, found).collect()}
    assert cycles.keys() == set(want.values())
    for k, c in cycles.items():
        assert c[0] == c[-1] == k and all(p in pairs for p in zip(c, c[1:], strict=False))
        shortest = next(d for d in range(2, 40) if any(len(w) == d for w in _loops(pairs, k, d)))
        assert len(c) - 1 == shortest


def test_hops_against_a_plain_version(spark):
    rng = random.Random(9)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(110)} | {(k, 59) for k in range(40)} | {(100 + k, 101 + k) for k in range(17)} | {(59, 100)})
    seeds = [0, 3, 4, 7, 9, 12]
    level, via, front, k = dict.fromkeys(seeds, 0), {s: [s] for s in seeds}, set(seeds), 0
    while front:
        k += 1
        new = {b for a, b in pairs if a in front} - level.keys()
        for b in new:
            via[b] = sorted({s for a, c in pairs if c == b and a in front for s in via[a]})[:3]
        level |= dict.fromkeys(new, k)
        front = new
    assert max(level.values()) > 16  # tables of levels are put together on the way
    got = graph.hops(spark.range(130), spark.createDataFrame(pairs, "src long, dst long").repartition(6), spark.createDataFrame([(s,) for s in seeds], "id long")).collect()
    assert {r["id"]: (r["hops"], r["via"]) for r in got} == {x: (level.get(x), via.get(x, [])) for x in range(130)}


def _loops(pairs, start, length):
    """One walk of that many edges from ``start`` back to it, if there is one without the edge to itself."""
    at = {start}
    for _ in range(length):
        at = {b for a, b in pairs if a in at and a != b}
    return [range(length)] if start in at else []


def test_hops_and_empty_graphs(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (5, 2), (2, 3)], "src long, dst long")
    got = {r["id"]: (r["hops"], r["via"]) for r in graph.hops(spark.range(7), e, spark.createDataFrame([(0,), (5,)], "id long")).collect()}
    assert got[2] == (1, [5]) and got[3] == (2, [5]) and got[4] == (None, []) and got[0] == (0, [0])
    none = e.limit(0)
    assert graph.strong_components(none).count() == 0
    assert graph.hops(spark.range(2), none, spark.range(1)).where(F.col("hops") == 0).count() == 1

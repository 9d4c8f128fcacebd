"""Plans are the ones the operators are written for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgraph import registry
from loomgraph.operators import resolve, staleness


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["import_extract", "unparsed_top", "mine_top", "touched_most", "docs_headings"])
def test_top_k_is_taken_in_each_task(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan(registry.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["resolve_prefix_scope", "resolve_priority", "ancestor_dirs", "uncovered", "shadow_guard", "staleness_sections", "content_hash_dups"])
def test_no_nested_loops(spark, sf_dir, name):
    p = plan(registry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_first_rule_wins_without_a_join_or_window(spark, sf_dir):
    p = plan(registry.queries()["redact"](spark, sf_dir))
    assert "Join" not in p and "Exchange" not in p and "Python" not in p
    assert "Window" not in plan(registry.queries()["zscore"](spark, sf_dir))


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    p = plan(registry.queries()["resolve_priority"](spark, sf_dir))
    assert "LessThan(p_size,10)" in p and "ReadSchema: struct<l_partkey:bigint>" in p


def test_candidates_prefer_the_first(spark):
    files = spark.createDataFrame([("a.ts",), ("a/index.ts",), ("b.tsx",), ("c/__init__.py",), ("d.js",)], "path string")
    specs = spark.createDataFrame([("a",), ("b.js",), ("c",), ("d.js",), ("none",)], "spec string").withColumn("cands", resolve.candidate_paths(F.col("spec")))
    assert {r["spec"]: r["path"] for r in resolve.first_existing(specs, files, "spec", "cands").collect()} == {"a": "a.ts", "b.js": "b.tsx", "c": "c/__init__.py", "d.js": "d.js"}


def test_globs_claim_their_literal_start(spark):
    found = spark.createDataFrame([("s", ["src/a*", "lib/**", "**"])], "id string, files array<string>")
    paths = spark.createDataFrame([("src/ab.ts",), ("src/b.ts",), ("lib/x/y.ts",), ("top.ts",)], "path string")
    assert {r["path"] for r in staleness.uncovered(paths, found).collect()} == {"src/b.ts", "top.ts"}


def test_changes_are_shuffled_by_the_keys_that_claims_have(spark):
    """No row for the root, which all paths share, unless a glob starts there; and each change once, though paths come again."""
    paths = spark.createDataFrame([("a/b/c.ts", 1), ("a/b/c.ts", 2), ("a/x.ts", 3), ("top.ts", 4)], "path string, n int")
    for files, rows, want in ((["a/b/*"], 2, {1, 2}), (["a/b/*", "a/x.ts"], 6, {1, 2, 3}), (["t*"], 4, {4}), (["**"], 0, set())):
        hit = staleness.matched(staleness.claims(spark.createDataFrame([("s", files)], "id string, files array<string>")), paths)
        assert {r["n"] for r in hit.collect()} == want
        assert staleness.keyed(paths, staleness.claims(spark.createDataFrame([("s", files)], "id string, files array<string>"))).count() == rows


@pytest.mark.parametrize("name", ["edge_flags", "fan_in_out", "global_counts"])
def test_no_window_over_a_whole_table(spark, sf_dir, name):
    p = plan(registry.queries()[name](spark, sf_dir))
    windows = [line for line in p.split("\n") if "Window [" in line]
    assert all("windowspecdefinition(part" in line for line in windows)

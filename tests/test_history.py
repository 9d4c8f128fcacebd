"""History in several partitions, with filters pushed to git, and commits as a stream."""

from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import git
from loomgraph.streaming import commits


def _run(root, *a, name="Ann O.", at=None):
    env = {"GIT_AUTHOR_DATE": f"@{at} +0000", "GIT_COMMITTER_DATE": f"@{at} +0000"} if at else {}
    subprocess.run(["git", "-C", str(root), "-c", f"user.name={name}", "-c", "user.email=a@x", *a], check=True, capture_output=True, env={**__import__("os").environ, **env})


def _commit(root, k):
    (root / "src").mkdir(exist_ok=True)
    (root / ("src/a.ts" if k % 3 else f"doc{k}.md")).write_text(f"{k}\n")
    _run(root, "add", ".")
    _run(root, "commit", "-qm", f"c{k}", name="Bob [x]" if k % 4 == 0 else "Ann O.", at=1_700_000_000 + 1000 * k)


@pytest.fixture(scope="module")
def history(tmp_path_factory):
    """Twelve commits, with a side branch that is merged."""
    root = tmp_path_factory.mktemp("history")
    _run(root, "init", "-q", "-b", "main")
    for k in range(8):
        _commit(root, k)
    _run(root, "checkout", "-qb", "side")
    (root / "side.txt").write_text("s\n")
    _run(root, "add", ".")
    _run(root, "commit", "-qm", "side", at=1_700_008_500)
    _run(root, "checkout", "-q", "main")
    for k in range(9, 12):
        _commit(root, k)
    _run(root, "merge", "-q", "--no-ff", "-m", "merge", "side", at=1_700_020_000)
    return root


def _read(spark, root, kind, span, **narrow):
    return git.read(spark, str(root), kind, span=span, **narrow)


@pytest.mark.parametrize("kind", sorted(git.HISTORY))
def test_spans_give_what_one_reader_gives(spark, history, kind):
    one, many = _read(spark, history, kind, 1000), _read(spark, history, kind, 3)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() >= 4
    rows = sorted(map(str, one.collect()))
    assert rows and sorted(map(str, many.collect())) == rows
    assert _read(spark, history / "none", kind, 3).count() == 0


def test_options_narrow_the_log(spark, history):
    c, f = _read(spark, history, "commits", 3), _read(spark, history, "commit_files", 3)
    rows, files = c.collect(), f.collect()
    for narrow, keep in (
        ({"author": "Bob [x]"}, lambda r: r["author"] == "Bob [x]"),
        ({"since": 1_700_005_000}, lambda r: r["committed_at"] >= 1_700_005_000),
        ({"until": 1_700_005_000, "author": "Ann O."}, lambda r: r["committed_at"] <= 1_700_005_000 and r["author"] == "Ann O."),
    ):
        got = _read(spark, history, "commits", 3, **narrow)
        assert {r["sha"] for r in got.collect()} == {r["sha"] for r in rows if keep(r)}
        assert got.rdd.getNumPartitions() < c.rdd.getNumPartitions()
    for path, keep in (("side.txt", lambda p: p == "side.txt"), ("src/", lambda p: p.startswith("src/")), ("doc3.md", lambda p: p == "doc3.md")):
        got = _read(spark, history, "commit_files", 3, path=path)
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in files if keep(r["path"])) and got.rdd.getNumPartitions() < 5
    one = _read(spark, history, "commit_files", 3)
    assert one.where("path = 'side.txt'").count() == 1 and one.count() == len(files)  # a frame can be scanned again with another filter


def test_commits_arrive_once(spark, tmp_path):
    root = tmp_path / "live"
    root.mkdir()
    _run(root, "init", "-q", "-b", "main")
    got: list = []

    def trigger():
        stream = git.arrivals(spark, str(root))
        commits.run_available(stream, lambda b, _: got.extend(b.select("path", "author", F.unix_timestamp("at").alias("at")).collect()), str(tmp_path / "ck")).awaitTermination(120)

    for k in range(3):
        _commit(root, k)
    trigger()
    assert len(got) == 3
    trigger()
    assert len(got) == 3  # nothing new
    _run(root, "checkout", "-qb", "side", "HEAD~2")
    (root / "side.txt").write_text("s\n")
    _run(root, "add", ".")
    _run(root, "commit", "-qm", "side", at=1_600_000_000)
    _run(root, "checkout", "-q", "main")
    _commit(root, 4)
    _run(root, "merge", "-q", "--no-ff", "-m", "merge", "side")
    trigger()  # an older commit that came by a merge is new here
    assert sorted((r["path"], r["at"]) for r in got) == sorted([("doc0.md", 1_700_000_000), ("src/a.ts", 1_700_001_000), ("src/a.ts", 1_700_002_000), ("src/a.ts", 1_700_004_000), ("side.txt", 1_600_000_000)])

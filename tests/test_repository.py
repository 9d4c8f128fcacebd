from __future__ import annotations

import json
import subprocess

import pytest

from loomgraph.operators import surfaces
from loomgraph.plans import refresh, scan

FILES = {
    "tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}} }',
    "package.json": '{"name": "demo", "main": "dist/index.js", "dependencies": {"stripe": "1"}}',
    "src/index.ts": "import { b } from '@/b';\nexport const x = b;\n",
    "src/b.ts": "import { c } from './c.js';\nimport type { T } from './t';\nexport const b = c;\n",
    "src/c.ts": "import { b } from './b';\nimport stripe from 'stripe';\nif (b) { for (;;) {} }\nexport const c = 1;\n",
    "src/t.ts": "import type { X } from './b';\nexport type T = number;\n",
    "src/orphan.ts": "export const lost = 1;\n",
    "app/main.py": "from .util import helper\nimport os\nfrom app import other\nif __name__ == '__main__':\n    helper()\n",
    "app/__init__.py": "",
    "app/util.py": "def helper():\n    return 1\n",
    "app/other.py": "x = 1\n",
    "app/stripe.py": "y = 1\n",
    "db/migrations/1.sql": "select 1;\n",
    "node_modules/x/y.js": "ignored",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann O.", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    run("add", "-f", ".")
    run("commit", "-qm", "first")
    (root / "src/c.ts").write_text(FILES["src/c.ts"] + "// more\n")
    run("commit", "-qam", "second")
    return root


def test_scan(spark, repo, tmp_path):
    config = scan.ScanConfig(str(repo), since="10 years ago", author="ann (", top="nope")
    assert config.top == 25
    result = scan.scan_repository(spark, config)
    edges = {(r["src"], r["dst"]): r for r in result.edges.collect()}
    assert ("src/index.ts", "src/b.ts") in edges and ("src/b.ts", "src/c.ts") in edges and ("src/c.ts", "src/b.ts") in edges
    assert not edges["src/b.ts", "src/t.ts"]["is_value"]
    assert ("app/main.py", "app/util.py") in edges and ("app/main.py", "app/other.py") in edges
    assert {r["id"]: r["component"] for r in result.components.collect()} == {"src/b.ts": "src/b.ts", "src/c.ts": "src/b.ts"}
    files = {r["path"]: r for r in result.files.collect()}
    assert "node_modules/x/y.js" not in files
    assert files["src/b.ts"]["hops"] == 1 and files["src/orphan.ts"]["hops"] is None
    assert files["src/c.ts"]["churn"] == 2 and files["src/c.ts"]["complexity"] == 2
    assert files["src/index.ts"]["surface"] == "public-api" and files["db/migrations/1.sql"]["surface"] == "migration"
    assert [r["package"] for r in result.externals.collect()] == ["stripe"]
    assert {r["code"] for r in result.warnings.collect()} >= {"few-commits"}
    scan.write_report(result, str(tmp_path / "out"), config, "2026-01-01T00:00:00Z")
    document = json.loads((tmp_path / "out/scan.json").read_text())
    assert document["cycles"] == [["src/b.ts", "src/c.ts", "src/b.ts"]] and "scan" in (tmp_path / "out/scan.md").read_text().lower()


def test_staleness_and_recon(spark, repo, tmp_path):
    log = subprocess.run(["git", "-C", str(repo), "log", "--format=%h"], check=True, capture_output=True, text=True).stdout.split()
    text = f'<!-- loom:section id="s" sha="{log[1]}" files="src/c.ts, app/**" -->\n<!-- loom:section id="now" sha="{log[0]}" files="src/b.ts" -->\n<!-- loom:section id="bad" sha="0123456" files="x" -->\n```\n<!-- loom:section id="no" -->\n```\n'
    found = refresh.refresh(spark, str(repo), text)
    assert [(r["id"], r["changed"]) for r in found["stale"].collect()] == [("s", ["src/c.ts"])]
    assert [(r["id"], r["why"]) for r in found["unverifiable"].collect()] == [("bad", "commit is gone")]
    uncovered = {r["path"] for r in found["uncovered"].collect()}
    assert "src/orphan.ts" in uncovered and "app/main.py" not in uncovered
    assert refresh.document_sections(spark, text)[1] == 1
    assert refresh.write_stale(found, str(tmp_path / "stale.md")).startswith("1 stale")
    assert "src/c.ts (2)" in refresh.recon(spark, str(repo), since="10 years ago")
    with pytest.raises(RuntimeError):
        refresh.recon(spark, str(tmp_path))


def test_declared_surfaces(spark):
    files = spark.createDataFrame([("a b.ts",), ("c.ts",)], "path string")
    lines = spark.createDataFrame([("a b.ts",), ("./c.ts cron # why",), ("gone.ts x",), ("# only",)], "value string")
    assert {(r["path"], r["kind"]) for r in surfaces.parse_declared(lines, files).collect()} == {("a b.ts", "declared"), ("c.ts", "cron")}


def test_stream(spark, tmp_path):
    from loomgraph.streaming import commits

    spark.createDataFrame([("s1", "a", "2026-01-02", "x"), ("s2", "b", "2026-01-01", "y")], "sha string, path string, at string, author string").selectExpr("sha", "path", "timestamp(at) at", "author").write.parquet(str(tmp_path / "in"))
    claims = spark.createDataFrame([("sec", "a", "2026-01-01"), ("sec", "b", "2026-01-01")], "id string, path string, s string").selectExpr("id", "path", "timestamp(s) stamped_at")
    got: list = []
    q = commits.run_available(commits.stale_on_arrival(commits.touched(spark, str(tmp_path / "in")), claims), lambda b, _: got.extend(b.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [(r["id"], r["path"]) for r in got] == [("sec", "a")]


def _git(root, *a):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann O.", "-c", "user.email=a@x", *a], check=True, capture_output=True, text=True).stdout


@pytest.fixture(scope="module")
def branched(tmp_path_factory):
    """A clone that is behind its upstream and has work of its own: a rename, an added and a changed file, a merge, declared entry points."""
    top = tmp_path_factory.mktemp("upstream")
    _git(top, "init", "-q", "-b", "main")
    for path, text in {"src/a.py": "from src import b\nfrom .gone import x\nimport missing_local.sub\nimport numpy\n", "src/b.py": "x = 1\n", "src/old.py": "y = 1\n" * 9, "tests/test_a.py": "import src.only_tested\n", "src/only_tested.py": "z = 1\n", "missing_local/x.css": "", "docs/x.md": "intro\n# Head of x\n", "package.json": '{"scripts": {"build": "make"}}', "página ñ.py": "q = 1\n"}.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    _git(top, "add", ".")
    _git(top, "commit", "-qm", "one")
    root = tmp_path_factory.mktemp("clones") / "demo"
    _git(top, "clone", "-q", str(top), str(root))
    (top / "src/newer.py").write_text("w = 1\n")
    _git(top, "add", ".")
    _git(top, "commit", "-qm", "upstream only")
    _git(root, "fetch", "-q")
    _git(root, "checkout", "-qb", "work")
    _git(root, "mv", "src/old.py", "src/renamed.py")
    (root / "src/fresh.py").write_text("v = 1\n")
    _git(root, "add", ".")
    _git(root, "commit", "-qm", "own work API_TOKEN=abcdef123")
    _git(root, "branch", "-q", "--set-upstream-to", "origin/main")
    (root / ".loomgraph").mkdir()
    (root / ".loomgraph/surfaces.txt").write_text("src/a.py cron # why\n./página ñ.py\ngone.py x\n")
    (root / "src/b.py").write_text("x = 2\n")
    return root


def test_points_in_time(spark, branched):
    first = _git(branched, "rev-list", "--max-parents=0", "HEAD").strip()
    text = f'<!-- loom:section id="old" sha="{first[:8]}" files="src/old.py, src/b.py" -->\n<!-- loom:section id="typo" sha="{first[:8]}" files="src/b.py, src/never.py" -->\n<!-- loom:section id="x" sha="{first}" files="docs/**" -->\n'
    found = refresh.refresh(spark, str(branched), text)
    # src/old.py is gone now but was there at the stamp; src/never.py is at neither end
    assert [(r["id"], r["why"]) for r in found["unverifiable"].collect()] == [("typo", "no such file: src/never.py")]
    assert [(r["id"], r["changed"]) for r in found["stale"].collect()] == [("old", ["src/old.py"])]
    assert {r["path"] for r in found["added"].collect()} == {"src/renamed.py", "src/fresh.py"}
    assert {r["path"] for r in found["uncovered"].collect()} > {"src/a.py", "src/renamed.py", "src/fresh.py"}


def test_activity_digest(spark, branched):
    requests = spark.createDataFrame([(7, "Newer", "bo", "merged", "2026-01-02", "Why so\n\nbecause"), (8, "Later", "cy", "open", "2026-01-03", None)], "id long, title string, author string, state string, at string, body string")
    files = spark.createDataFrame([(7, "src/newer.py", 1, 0), (7, "src/a.py", 2, 3)], "id long, path string, added long, deleted long")
    text = refresh.recon(spark, str(branched), since="10 years ago", author="ann", requests=requests, request_files=files)
    for part in ("behind 1", "1 commits behind", "- M src/b.py", "- src/b.py +1 -1", "own work API_TOKEN=***", "src/fresh.py", "#8 Later (cy", "### #7 Newer", "  - src/a.py (+2/-3)", "  > because", "not in this checkout\n- src/newer.py", "docs/x.md: Head of x", "build: make"):
        assert part in text, part
    assert "## Merges" in refresh.recon(spark, str(branched), since="10 years ago")


def test_scan_digest(spark, branched, tmp_path):
    config = scan.ScanConfig(str(branched), since="10 years ago", author="ann")
    result = scan.scan_repository(spark, config)
    kinds = {r["path"]: r["kind"] for r in result.surfaces.collect()}
    assert kinds["src/a.py"] == "cron" and kinds["página ñ.py"] == "declared" and kinds["tests/test_a.py"] == "test"
    health = result.counts.first()
    assert health["unresolved"] == 2  # .gone and missing_local, which is a folder here; numpy is a package of others
    assert {(r["head"], r["n"]) for r in result.heads.collect()} == {(".gone", 1), ("missing_local", 1)}
    scan.write_report(result, str(tmp_path), config, "2026-01-01T00:00:00Z")
    digest = (tmp_path / "scan.md").read_text()
    parts = digest.split("## ")
    of = {p.split("\n")[0]: p for p in parts}
    assert "src/only_tested.py (imported by 1)" in of["Reached only from tests"] and "src/fresh.py" in of["Imported by nothing"]
    assert "cron (1): src/a.py" in of["Surfaces"] and "test" not in of["Surfaces"].replace("tests", "")
    assert "src/a.py → 1 → src/b.py" in of["From surfaces to these"] and "src/a.py (1" in of["Yours"] and "missing_local (1)" in digest


def test_running_churn(spark, tmp_path):
    """Touches of two triggers add up by day; a row behind the watermark no longer counts."""
    from loomgraph.streaming import commits

    def land(name, rows):
        spark.createDataFrame(rows, "sha string, path string, at string, author string").selectExpr("sha", "path", "timestamp(at) at", "author").coalesce(1).write.parquet(str(tmp_path / "new" / name))
        (tmp_path / "in").mkdir(exist_ok=True)
        for k, f in enumerate((tmp_path / "new" / name).glob("*.parquet")):
            f.rename(tmp_path / "in" / f"{name}-{k}.parquet")

    got: dict = {}

    def run():
        churn = commits.running_churn(commits.touched(spark, str(tmp_path / "in")))
        q = commits.run_available(churn, lambda b, _: got.update({(str(r["window"]["start"])[:10], r["path"]): (r["churn"], r["authors"]) for r in b.collect()}), str(tmp_path / "ck"), "update")
        assert q.awaitTermination(120) and q.exception() is None

    land("a", [("1", "x", "2026-01-01 01:00", "p"), ("2", "x", "2026-01-01 02:00", "q"), ("3", "y", "2026-01-09 00:00", "p")])
    run()
    land("b", [("4", "y", "2026-01-09 05:00", "p"), ("5", "x", "2026-01-01 03:00", "r")])
    run()
    assert got == {("2026-01-01", "x"): (2, 2), ("2026-01-09", "y"): (2, 1)}

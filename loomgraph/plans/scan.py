"""The structural scan of a repository: files, imports, graph, surfaces, history, score."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, dirname
from ..operators import activity, files, graph, imports, report, resolve, scoring, surfaces
from ..sources import git, manifests
from .storage import written


@dataclass
class ScanConfig:
    """Parameters of a scan; a ``top`` that isn't a number is 25. ``folder``, below the root, may hold ``surfaces.txt``, a file of declared entry points."""

    root: str
    since: str = "90 days ago"
    author: str | None = None
    top: int | str = 25
    exclude: list[str] = field(default_factory=list)
    as_of: int | None = None
    folder: str = ".loomgraph"

    def __post_init__(self) -> None:
        try:
            self.top = int(self.top)
        except (TypeError, ValueError):
            self.top = 25


@dataclass
class Scan:
    """Tables of a finished scan."""

    files: DataFrame
    edges: DataFrame
    ranked: DataFrame
    unparsed: DataFrame
    components: DataFrame
    surfaces: DataFrame
    externals: DataFrame
    counts: DataFrame
    warnings: DataFrame
    heads: DataFrame


def scan_tables(spark: SparkSession, texts: DataFrame, commits: DataFrame, commit_files: DataFrame, config: ScanConfig, small: dict[str, str] | None = None, declared: DataFrame | None = None, shallow: bool = False, tracked: int = 0, truncated: int = 0, excluded: int = 0) -> Scan:
    """The scan of ``texts(ord, path, bytes, content, partial)`` and history; ``small`` holds package and compiler configurations by path."""
    small = small or {}
    f = written(files.features(texts), "features")
    packages, scopes = manifests.workspace_packages(spark, small), manifests.path_aliases(spark, small)
    blocked = manifests.declared(texts).unionByName(spark.createDataFrame([(n,) for n in resolve.PY_STDLIB], "name string"))
    scripts, python = f.where("ext <> '.py'"), f.where("ext = '.py'")
    js = written(imports.js_imports(scripts).withColumn("id", F.monotonically_increasing_id()), "js")
    py = written(imports.python_imports(python).withColumn("id", F.monotonically_increasing_id()), "py")
    js_hit = resolve.resolve_js(js, f, packages, scopes)
    py_hit = resolve.resolve_python(py, f, blocked)
    js_edges = js.join(js_hit, "id").select(F.col("path").alias("src"), "dst", "is_type", "is_lazy")
    py_edges = py.join(py_hit, "id").select(F.col("path").alias("src"), "dst", F.lit(False).alias("is_type"), F.lit(False).alias("is_lazy"))
    e = written(resolve.edges(js_edges.unionByName(py_edges)), "edges")
    missing = js.join(js_hit, "id", "left_anti").select("spec")
    py_missing = py.join(py_hit, "id", "left_anti").select(F.concat(F.expr("repeat('.', level)"), "module").alias("spec"))
    folders = f.select(F.explode(ancestors(dirname(F.col("path")))).alias("dir")).select(basename(F.col("dir")).alias("name")).distinct()
    unresolved = written(resolve.with_first_party(missing.unionByName(py_missing), folders, packages, blocked, os.path.basename(os.path.abspath(config.root))), "unresolved")
    py_out = py.where("level = 0").join(py_hit, "id", "left_anti").select(F.substring_index("module", ".", 1).alias("spec"))
    py_out = py_out.join(spark.createDataFrame([(n,) for n in resolve.PY_STDLIB], "spec string"), "spec", "left_anti")
    outside = missing.where(~F.col("spec").startswith(".")).unionByName(py_out)
    nodes = f.select(F.col("path").alias("id"))
    rank = graph.pagerank(nodes, e.where("is_value"))
    parts = graph.strong_components(e.where("is_static"))
    entries = {p for path, text in small.items() if path.endswith("package.json") for p in manifests.package_entries(text)}
    entry_rows = spark.createDataFrame([(p,) for p in entries], "entry string").select(F.explode(surfaces.entry_candidates(F.col("entry"))).alias("path")).join(f.select("path"), "path", "left_semi")
    said = declared if declared is not None else spark.createDataFrame([], "path string, kind string")
    found = written(surfaces.surfaces(f, said.join(f.select("path"), "path", "left_semi"), entry_rows), "surfaces")
    reached = graph.hops(nodes, e, found.where("kind <> 'test'").select(F.col("path").alias("id")))
    churned = activity.churn(commits, activity.of_tracked(commit_files, f), config.author)
    joined = f.drop("content", "nocomment", "clean").join(rank.withColumnRenamed("id", "path"), "path", "left").join(graph.fan(e).withColumnRenamed("id", "path"), "path", "left")
    joined = joined.join(churned, "path", "left").join(found.withColumnRenamed("kind", "surface"), "path", "left").join(reached.withColumnRenamed("id", "path"), "path", "left")
    into = e.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_list("dst")).alias("imports"), F.sort_array(F.collect_list(F.when(F.col("is_lazy"), F.col("dst")))).alias("lazy_imports"))
    as_of = F.lit(config.as_of) if config.as_of is not None else F.unix_timestamp(F.current_timestamp())
    scored = written(scoring.hotspots(joined.join(into, "path", "left"), as_of), "scored")
    shown = F.col("surface")
    counts = scored.agg(
        F.lit(tracked).alias("tracked_files"), F.count(F.lit(1)).alias("scanned_files"), F.count_if(shown.isNotNull() & (shown != "test")).alias("surfaces"), F.count_if(shown == "test").alias("test_files"),
        F.count_if((F.col("loc") > 0) & F.col("generated").isNull()).alias("code_files"), F.lit(truncated).alias("not_scanned"), F.lit(excluded).alias("excluded"),
        F.count_if(F.col("generated").isNotNull()).alias("generated"), F.count_if("partial").alias("partial"), F.count_if(F.col("hops").isNull() & ~shown.eqNullSafe("test")).alias("unreachable"),
    )
    counts = counts.crossJoin(e.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(parts.agg(F.count_distinct("component").alias("cycles")))
    specs = js_hit.select(F.lit(True).alias("resolved"), F.lit(True).alias("own")).unionByName(py_hit.select(F.lit(True).alias("resolved"), F.lit(True).alias("own")))
    specs = specs.unionByName(unresolved.select(F.lit(False).alias("resolved"), "own"))
    health = commits.agg(F.count(F.lit(1)).alias("commits")).crossJoin(resolve.health(specs).withColumnRenamed("unresolved_own", "unresolved"))
    health = health.select(F.lit(truncated).alias("truncated"), F.lit(shallow).alias("shallow"), "commits", "resolved", "unresolved")
    said_about = report.warnings(health, report.by_extension(f, e))
    return Scan(scored, e, files.rankable(scored).orderBy(F.desc("score"), "ord"), scored.where("loc = 0").orderBy(F.desc("churn"), "ord").limit(40), parts, found, imports.external_counts(outside), counts.crossJoin(health), said_about, resolve.heaviest(unresolved))


def read_texts(names: DataFrame, root: str) -> DataFrame:
    """``(ord, path, bytes, content, partial)`` of files ``(ord, path)`` below a folder: beyond 2 MiB their first 512 KiB; files that can't be read are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p in zip(b["ord"], b["path"], strict=True):
                try:
                    size = os.path.getsize(at := os.path.join(root, p))
                    with open(at, "rb") as f:
                        raw = f.read() if size <= files.FULL_READ else f.read(files.HEAD_READ)
                    rows.append((k, p, size, raw.decode("utf-8", "replace"), size > files.FULL_READ))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["ord", "path", "bytes", "content", "partial"])

    return names.select("ord", "path").mapInPandas(read, "ord long, path string, bytes long, content string, partial boolean")


def declared_surfaces(spark: SparkSession, config: ScanConfig, tracked: DataFrame) -> DataFrame:
    """``(path, kind)`` of the file of declared entry points; none if there is no such file."""
    try:
        with open(os.path.join(config.root, config.folder, "surfaces.txt"), encoding="utf-8") as f:
            lines = f.read().split("\n")
    except OSError:
        lines = []
    return surfaces.parse_declared(spark.createDataFrame([(x,) for x in lines], "value string"), tracked)


def scan_repository(spark: SparkSession, config: ScanConfig) -> Scan:
    """The scan of a git repository on a file system that the driver sees."""
    tracked = written(git.read(spark, config.root, "tracked"), "tracked")
    code = files.scannable(tracked, config.exclude)
    wanted, left_out = code.where("NOT excluded"), code.where("excluded").count()
    kept = written(files.capped(wanted), "kept")
    n = max(0, wanted.count() - files.MOST_FILES)

    texts = written(read_texts(kept, config.root), "texts")
    extra = written(read_texts(tracked.where(F.col("path").rlike(r"(?:^|/)(?:package\.json|[tj]sconfig[^/]*\.json|requirements[^/]*|constraints\.txt|pyproject\.toml|Pipfile|setup\.cfg)$|(?:^|/)requirements/[^/]+$")), config.root), "extra")
    small = {r["path"]: r["content"] for r in extra.where(F.col("path").endswith(".json")).select("path", "content").toLocalIterator()}
    state = git.probe(config.root)
    result = scan_tables(spark, texts.unionByName(extra.join(texts.select("path"), "path", "left_anti")), git.read(spark, config.root, "commits", config.since), git.read(spark, config.root, "commit_files", config.since), config, small, declared_surfaces(spark, config, tracked), shallow=bool(state["shallow"]), tracked=tracked.count(), truncated=n, excluded=left_out)
    return result


def atomic_write(path: str, text: str) -> None:
    """Writes beside the target, then renames, so that readers see the old or the new text."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temporary, path)


# How many rows each list of the digest has.
SHOWN, CYCLES, ORPHANS, MINE, CHURNY, EXTERNALS = 12, 8, 15, 15, 8, 15


def write_report(scan: Scan, folder: str, config: ScanConfig, generated_at: str) -> None:
    """``scan.json`` and ``scan.md`` with one time stamp; the folder ignores itself. Lists are cut to their report's length before they come to the driver."""
    atomic_write(os.path.join(folder, ".gitignore"), "*\n")
    best = written(scan.ranked.limit(int(config.top)), "best")
    top = [r.asDict(recursive=True) for r in report.records(best.orderBy(F.desc("score"), "ord")).collect()]
    kinds = {r["kind"]: (r["n"], r["paths"]) for r in surfaces.by_kind(scan.surfaces, SHOWN).collect()}
    said = [r.asDict() for r in scan.warnings.collect()]
    counts, heads = scan.counts.first().asDict(), [r.asDict() for r in scan.heads.collect()]
    document = {"generatedAt": generated_at, "counts": counts, "surfaces": {k: paths for k, (_, paths) in kinds.items()}, "warnings": said, "unresolvedHeads": heads, "externals": [r.asDict() for r in scan.externals.collect()], "files": top, "unparsed": [r["path"] for r in scan.unparsed.select("path").collect()]}
    cycles = graph.cycle_witnesses(scan.edges.where("is_static"), scan.components).orderBy("component").limit(20)
    document["cycles"] = [r["cycle"] for r in cycles.collect()]
    nodes = scan.files.select(F.col("path").alias("id"), "hops", "via", "fan_in", "score", "ord")
    ways = graph.surface_paths(nodes, scan.edges, best.select(F.col("path").alias("id"))).orderBy("hops", "via", "id").limit(int(config.top)).collect()
    tests = scan.surfaces.where("kind = 'test'").select(F.col("path").alias("id"))
    ranked = files.rankable(scan.files).select(F.col("path").alias("id"))
    lost = written(graph.orphans(nodes.join(ranked, "id", "left_semi"), nodes, tests).join(nodes.select("id", "fan_in", "score", "ord"), "id"), "lost")
    atomic_write(os.path.join(folder, "scan.json"), json.dumps(document, default=str, indent=1))
    lines = [f"# Scan {generated_at}", "", f"{counts['generated']} files are left out of the ranking as generated, {counts['excluded']} by request.", ""]
    lines += [f"> {w['code']}: {w['detail']}" for w in said] + [f"> unresolved most: {', '.join(f'{h['head']} ({h['n']})' for h in heads)}"] * bool(heads)
    lines += ["", "## Surfaces", *(f"- {k} ({n}): {', '.join(paths)}{f' and {n - SHOWN} more' if n > SHOWN else ''}" for k, (n, paths) in sorted(kinds.items()) if k != "test")]
    lines += ["", f"## Top {config.top}", "", "| # | file | why | score | rank | fan-in | lines | decisions | depth | commits | yours | touched | hops |", "|-|-|-|-|-|-|-|-|-|-|-|-|-|"]
    lines += [f"| {k} | {r['path']} | {r['why']} | {r['score']} | {r['rank']} | {r['fan_in']} | {r['loc']} | {r['complexity']} | {r['max_depth']} | {r['churn']} | {r['my_churn']} | {r['last_touched'] or '—'} | {'∞' if r['hops'] is None else r['hops']} |" for k, r in enumerate(top, 1)]
    lines += ["", "## From surfaces to these", *(f"- {r['via']} → {r['hops']} → {r['id']}{' (lazily)' if r['lazy'] else ''}" for r in ways)]
    lines += ["", "## Cycles", *(f"- {' → '.join(c)}" for c in document["cycles"][:CYCLES])]
    for title, only in (("Imported by nothing", False), ("Reached only from tests", True)):
        rows = lost.where(F.col("only_tests") == only)
        n, shown = rows.count(), rows.orderBy(F.desc("score"), "ord").limit(ORPHANS).collect()
        lines += ["", f"## {title}", *(f"- {r['id']}{f' (imported by {r['fan_in']})' if only else ''}" for r in shown)] + [f"- and {n - ORPHANS} more"] * (n > ORPHANS)
    if config.author:
        own = activity.mine_top(files.rankable(scan.files), MINE).select("path", "my_churn", activity.iso_date(F.col("last_touch")).alias("day"))
        lines += ["", "## Yours", *(f"- {r['path']} ({r['my_churn']}, last {r['day']})" for r in own.collect())]
    churny = activity.churny_unparsed(scan.files, most=CHURNY).select("path", "churn", F.coalesce("generated", F.lit("no code")).alias("reason"))
    lines += ["", "## Changed often, not parsed", *(f"- {r['path']} ({r['churn']}, {r['reason']})" for r in churny.collect())]
    lines += ["", "## Packages", ", ".join(f"{e['package']} ({e['n']})" for e in document["externals"][:EXTERNALS])]
    atomic_write(os.path.join(folder, "scan.md"), "\n".join(lines) + "\n")

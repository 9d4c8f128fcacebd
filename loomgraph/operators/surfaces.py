"""What a file is to the outside: test, route, page, tool, command, worker and so on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds with the paths or code that show them, in the order in which they are tried.
_PATH, _CODE, _RAW = "path", "clean", "content"
RULES: list[tuple[str, list[tuple[str, str]]]] = [
    ("test", [(_PATH, r"(?:^|/)(?:test|tests|__tests__|spec|e2e|fixtures)/|\.(?:test|spec)\.[a-z]+$")]),
    ("example", [(_PATH, r"(?i)(?:^|/)(?:examples?|samples?|demos?|site|docs?)/")]),
    ("config", [(_PATH, r"(?:^|/)[A-Za-z0-9_.-]*\.?config\.[cm]?[jt]s$|(?:^|/)(?:vite|vitest|webpack|rollup|jest|eslint|tailwind|next|nuxt|astro|svelte|babel)\.config\.")]),
    ("http-route", [(_CODE, r"(?<![A-Za-z0-9_])(?:app|router|server|fastify|hono|api_router|bp|blueprint)\s*\.\s*(?:get|post|put|patch|delete|all|head|options|websocket|ws)\s*\(")]),
    ("http-route", [(_CODE, r"@\s*[A-Za-z0-9_.]*\s*(?:app|router|api_router|bp|blueprint)\s*\.\s*(?:get|post|put|patch|delete|head|options|websocket)\s*\(")]),
    ("http-route", [(_CODE, r"@\s*[A-Za-z0-9_.]+\.route\s*\(|\.add_url_rule\s*\(|\.add_api_route\s*\(|include_router\s*\(")]),
    ("http-route", [(_CODE, r"(?m)^\s*urlpatterns\s*=|=\s*(?:FastAPI|Flask|Starlette|Quart)\s*\(")]),
    ("http-route", [(_CODE, r"(?<![A-Za-z0-9_])(?:createRoute|registerRoutes|addRoute)\s*\(")]),
    ("web-page", [(_PATH, r"(?:^|/)(?:app|pages|routes)/(?:.*/)?(?:page|route|layout|template|\+page|\+server)\.[tj]sx?$|(?:^|/)pages/(?!api/).*\.[tj]sx$")]),
    ("web-page", [(_PATH, r"\.html$")]),
    ("ui-component", [(_PATH, r"\.(?:tsx|jsx|vue|svelte)$"), (_RAW, r"return\s*\(?\s*<|</[A-Za-z]|<template")]),
    ("mcp-tool", [(_CODE, r"(?<![A-Za-z0-9_])(?:server\.(?:tool|registerTool)|ListToolsRequestSchema|CallToolRequestSchema|tools/list)(?![A-Za-z0-9_])|@\s*\w+\.tool\s*\(|def\s+(?:list_tools|call_tool)(?![A-Za-z0-9_])")]),
    ("cli-command", [(_CODE, r"(?<![A-Za-z0-9_])(?:commander|yargs|process\.argv)|(?<=[A-Za-z0-9_])\.command\s*\(|(?<=[A-Za-z0-9_])@oclif")]),
    ("cli-command", [(_CODE, r"(?m)^\s*if\s+__name__\s*==\s*['\"]__main__['\"]|argparse\.ArgumentParser|@\s*click\.(?:command|group)|typer\.Typer\s*\(")]),
    ("worker", [(_CODE, r"@\s*[A-Za-z0-9_.]*\.?(?:shared_task|task)\s*[(\n]|Celery\s*\(|BackgroundScheduler|asyncio\.run\s*\(|(?<![A-Za-z0-9_])new Worker\s*\(")]),
    ("migration", [(_PATH, r"(?i)(?:^|/)(?:migrations?|db/migrate|drizzle|prisma|alembic/versions)/|\.sql$")]),
]


# Of a kind's patterns over code, what the code must hold for any of them to match.
NEEDLES: dict[str, tuple[str, ...]] = {
    RULES[3][1][0][1]: ("app", "router", "server", "fastify", "hono", "bp", "blueprint"),
    RULES[4][1][0][1]: ("@",),
    RULES[5][1][0][1]: (".route", ".add_url_rule", ".add_api_route", "include_router"),
    RULES[6][1][0][1]: ("urlpatterns", "FastAPI", "Flask", "Starlette", "Quart"),
    RULES[7][1][0][1]: ("createRoute", "registerRoutes", "addRoute"),
    RULES[11][1][0][1]: ("server.tool", "server.registerTool", "ListToolsRequestSchema", "CallToolRequestSchema", "tools/list", ".tool", "list_tools", "call_tool"),
    RULES[12][1][0][1]: ("commander", "yargs", "process.argv", ".command", "@oclif"),
    RULES[13][1][0][1]: ("__name__", "argparse", "click", "typer"),
    RULES[14][1][0][1]: ("task", "Celery", "BackgroundScheduler", "asyncio", "new Worker"),
}


def surface_kind(rules: list[tuple[str, list[tuple[str, str]]]] | None = None) -> Column:
    """The kind of the first rule whose patterns all match ``path``, ``clean`` and ``content``; else null. One expression, no join.

    A pattern over code runs only where the code holds one of its needles, as byte searches cost a fraction of it.
    """
    kinds = []
    for kind, tests in rules or RULES:
        hit = F.lit(True)
        for column, pattern in tests:
            text = F.coalesce(F.col(column), F.lit(""))
            found = [text.contains(n) for n in NEEDLES.get(pattern, ())]
            hit = hit & (reduce(lambda a, b: a | b, found) & text.rlike(pattern) if found else text.rlike(pattern))
        kinds.append(F.when(hit, F.lit(kind)))
    return F.coalesce(*kinds)


def surfaces(files: DataFrame, declared: DataFrame, entries: DataFrame) -> DataFrame:
    """``(path, kind)``: declared kinds outrank detected ones, package entries fill what is left as public-api.

    ``declared(path, kind)`` rows of paths that aren't files are ignored.
    """
    found = files.select("path", surface_kind().alias("detected"))
    joined = found.join(declared.select("path", F.col("kind").alias("said")).dropDuplicates(["path"]), "path", "left")
    joined = joined.join(entries.select("path").distinct().withColumn("entry", F.lit("public-api")), "path", "left")
    return joined.select("path", F.coalesce("said", "detected", "entry").alias("kind")).where("kind IS NOT NULL")


def parse_declared(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, kind)`` from lines ``path`` or ``path kind``: cut at the last white space, but only if what stands before it is a file."""
    text = F.regexp_replace(F.trim(F.regexp_replace("value", r"(?:^|\s)#.*$", "")), r"^\./", "")
    rows = lines.select(text.alias("line")).where("line <> ''").select("line", F.regexp_extract("line", r"^(.*\S)\s+(\S+)$", 1).alias("head"), F.regexp_extract("line", r"^(.*\S)\s+(\S+)$", 2).alias("tail"))
    known = files.select("path").distinct()
    split = rows.join(known.withColumnRenamed("path", "head"), "head").select(F.col("head").alias("path"), F.col("tail").alias("kind"))
    whole = rows.join(known.withColumnRenamed("path", "line"), "line").select(F.col("line").alias("path"), F.lit("declared").alias("kind"))
    return whole.unionByName(split.join(whole, "path", "left_anti"))


def entry_candidates(entry: Column) -> Column:
    """Files that a package entry may mirror: itself, and its sources when it points into a build directory."""
    stem = F.regexp_replace(F.regexp_replace(entry, r"^\./", ""), r"\.[cm]?[jt]sx?$|\.d\.[cm]?ts$", "")
    src = F.regexp_replace(stem, r"^(?:dist|build|lib|out)/", "src/")
    return F.array_distinct(F.flatten(F.array(F.array(F.regexp_replace(entry, r"^\./", "")), *[F.array(*[F.concat(s, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", ".mjs")]) for s in (src, stem)])))


def by_kind(found: DataFrame, most: int | None = None) -> DataFrame:
    """``(kind, n, paths)``; with ``most`` only so many paths of a kind, in order."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy("path"))
    shown = found if most is None else found.withColumn("_k", place).where(F.col("_k") <= most).drop("_k")
    counts = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return shown.groupBy("kind").agg(F.sort_array(F.collect_list("path")).alias("paths")).join(counts, "kind")

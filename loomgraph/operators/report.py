"""Counts, warnings and the per-file report record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .activity import iso_date
from .files import LOGIC_EXT


def by_extension(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``(ext, n, edges)``."""
    out = edges.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("edges"))
    return files.join(out, "path", "left").groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))


def warnings(counts: DataFrame, languages: DataFrame) -> DataFrame:
    """``(code, severity, detail)``: what makes results of this scan doubtful.

    ``counts`` has one row (truncated, shallow, commits, resolved, unresolved); ``languages(ext, n, edges)``. Each rule is a filter on its one
    row, the rules are united. Between 20 unresolved imports and 15 per cent of the resolved ones nothing is said.
    """
    ratio = F.col("unresolved") / F.greatest(F.col("resolved"), F.lit(1))

    def rule(code: str, severity: str, when: Column, detail: Column) -> DataFrame:
        return counts.where(when).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))

    found = rule("truncated", "high", F.col("truncated") > 0, F.col("truncated"))
    found = found.unionByName(rule("shallow-clone", "high", F.col("shallow"), F.lit("history is cut off")))
    found = found.unionByName(rule("no-commits", "high", F.col("commits") == 0, F.col("commits")))
    found = found.unionByName(rule("few-commits", "low", F.col("commits").between(1, 2), F.col("commits")))
    found = found.unionByName(rule("some-unresolved", "low", F.col("unresolved").between(1, 20), F.col("unresolved")))
    found = found.unionByName(rule("many-unresolved", "high", (F.col("unresolved") > 20) & (ratio > 0.15), F.col("unresolved")))
    quiet = F.col("ext").isin(".sql", ".html", ".css", ".scss")
    parsed = F.col("ext").isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte", ".py")
    unparsed = languages.where(~quiet & ~parsed & (F.col("n") >= 10)).select(F.lit("unparsed-language").alias("code"), F.lit("high").alias("severity"), F.concat_ws(" ", "ext", "n").alias("detail"))
    broken = languages.where(parsed & (F.col("n") >= 20) & (F.col("edges") / F.col("n") < 0.1)).select(F.lit("broken-resolver").alias("code"), F.lit("high").alias("severity"), F.concat_ws(" ", "ext", "n", "edges").alias("detail"))
    return found.unionByName(unparsed).unionByName(broken)


def totals(files: DataFrame, edges: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: files, files with logic, their bytes, edges, value edges, commits and authors; each table is aggregated once, with map-side combining."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("ext").isin(*LOGIC_EXT)).alias("logic_files"), F.sum(F.col("bytes").cast("long")).alias("bytes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if("is_value").alias("value_edges"))
    c = commits.agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("author").alias("authors"))
    return f.crossJoin(e).crossJoin(c)


def field(record: Column, name: str) -> Column:
    """A field of a JSON object as text; null where it is absent or the text is no object."""
    return F.from_json(record, "map<string,string>")[name]


def as_json(fields: dict[str, Column]) -> Column:
    """One JSON object with these fields, in this order."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def records(files: DataFrame) -> DataFrame:
    """The report's record of each joined file row: missing numbers are 0, missing hops and dates stay null."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return files.select(
        "path", "surface", zero("loc"), zero("bytes"), zero("complexity"), zero("max_depth"), "generated", F.coalesce("partial", F.lit(False)).alias("partial"),
        F.round("rank", 6).alias("rank"), zero("fan_in"), zero("fan_out"), zero("churn"), zero("my_churn"), iso_date(F.col("last_touch")).alias("last_touched"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "hops", F.coalesce("via", F.array().cast("array<string>")).alias("reached_via"),
        F.coalesce("imported_by", F.array().cast("array<string>")).alias("imported_by"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports"),
        F.coalesce("lazy_imports", F.array().cast("array<string>")).alias("lazy_imports"), "copies", F.round("score", 3).alias("score"), "why",
    )

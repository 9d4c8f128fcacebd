"""Which sections of a document the code has outrun, which can't be verified, and what no section covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import java_quote

#: What marks a section's stamp in a document unless the caller says otherwise: ``<!-- loom:section id="..." sha="..." files="..." -->``.
MARKER = "loom:section"


def stamp(marker: str = MARKER) -> str:
    """The pattern of a stamp; its attributes are group 1."""
    return rf"<!--\s*{java_quote(marker)}\s+([^>]*?)-->"


def attribute(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf'(?:^|\s){name}="([^"]*)"', 1)


def listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def sections(docs: DataFrame, marker: str = MARKER) -> DataFrame:
    """``(doc, ord, id, sha, files)`` of every stamp in ``docs(doc, content)``; fences and inline code must be gone already."""
    rows = docs.select("doc", F.posexplode(F.regexp_extract_all("content", F.lit(stamp(marker)), F.lit(1))).alias("ord", "attrs"))
    name = attribute(F.col("attrs"), "id")
    return rows.select("doc", "ord", F.when(name == "", F.concat(F.lit("unnamed@"), "ord")).otherwise(name).alias("id"), attribute(F.col("attrs"), "sha").alias("sha"), listed(attribute(F.col("attrs"), "files")).alias("files"))


def swallowed(docs: DataFrame, marker: str = MARKER) -> DataFrame:
    """``(doc, swallowed)``: stamps of ``docs(doc, raw, content)`` that the raw text has and the stripped text lost."""
    n = lambda c: F.regexp_count(c, F.lit(rf"<!--\s*{java_quote(marker)}\s"))
    return docs.select("doc", (n("raw") - n("content")).alias("swallowed")).where("swallowed > 0")


def claims(found: DataFrame, *more: str) -> DataFrame:
    """``(id, pattern, prefix, is_glob)`` and columns of ``found``: each listed path; of a glob the literal part before its first star."""
    rows = found.select("id", *more, F.explode("files").alias("pattern"))
    return rows.select("id", *more, "pattern", F.substring_index("pattern", "*", 1).alias("prefix"), F.col("pattern").contains("*").alias("is_glob"))


_USABLE = "NOT is_glob OR prefix <> ''"


def _top() -> Column:
    """The directory of a glob's literal part."""
    return F.regexp_replace("prefix", "[^/]*$", "")


def keyed(paths: DataFrame, claimed: DataFrame) -> DataFrame:
    """``paths(path, ...)`` with ``_key``: a row for each kind of key that ``claimed`` has, the whole path or an ancestor of some depth.

    There are as many kinds as directories lie in one another. No key that every path shares, such as the root, is made unless a glob asks for it.
    """
    kinds = claimed.where(_USABLE).agg(F.collect_set(F.when(F.col("is_glob"), F.size(F.split(_top(), "/")) - 1).otherwise(-1)))
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    key = lambda k: F.when(k < 0, F.col("path")).when(k == 0, "").otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k), F.lit("/")))
    asked = F.transform(F.filter("_kinds", lambda k: k <= depth), key)
    return paths.withColumn("_kinds", kinds.scalar()).withColumn("_key", F.explode(asked)).drop("_kinds")


def matched(claimed: DataFrame, paths: DataFrame, all_claims: DataFrame | None = None) -> DataFrame:
    """Rows of ``claims`` beside those of ``paths(path, ...)`` that they name, by one equality join on ``keyed``.

    ``all_claims``, if given, is read for the kinds of keys instead, where ``claimed`` is dear and part of it.
    """
    key = F.when(F.col("is_glob"), _top()).otherwise(F.col("pattern"))
    hit = keyed(paths, all_claims or claimed).join(claimed.where(_USABLE).withColumn("_key", key), "_key")
    return hit.where(F.when(F.col("is_glob"), F.col("path").startswith(F.col("prefix"))).otherwise(F.col("path") == F.col("pattern"))).drop("_key")


def stale(found: DataFrame, commits: DataFrame, commit_files: DataFrame, shown: int = 8) -> DataFrame:
    """``(id, changed, commits)`` of sections with a listed file changed after their commit.

    ``commits(ord, sha)`` has 0 for the newest; a change is later if its ordinal is smaller than the stamp's. Sections at the newest commit and
    those whose commit is unknown are left out. Changes meet claims in one join; the commit order is a filter on it.
    """
    at = found.join(commits.select("sha", F.col("ord").alias("at")), "sha").where("at > 0")
    changes = commit_files.join(commits, "sha").select("path", "ord", "sha")
    later = matched(claims(at, "at"), changes, claims(found)).where("ord < at")
    newest = F.transform(F.slice(F.sort_array(F.collect_set(F.struct("ord", "sha"))), 1, shown), lambda x: x["sha"])
    return later.groupBy("id").agg(F.sort_array(F.collect_set("path")).alias("changed"), newest.alias("commits"))


def unverifiable(found: DataFrame, commits: DataFrame, known_paths: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """``(id, why)``: no commit, unknown commit, no files, or files that exist neither then nor now; ``files="-"`` is exempt. The first reason counts.

    ``known_paths(path)`` are those of now, ``trees(sha, path)`` those of each stamp's commit.
    """
    known = found.join(commits.select("sha", F.lit(True).alias("seen")), "sha", "left")
    named = claims(found).where("NOT is_glob AND pattern <> '-'").join(known_paths.select(F.col("path").alias("pattern")).distinct(), "pattern", "left_anti")
    if trees is not None:
        named = named.join(found.select("id", "sha"), "id").join(trees.select("sha", F.col("path").alias("pattern")), ["sha", "pattern"], "left_anti")
    bogus = named.groupBy("id").agg(F.sort_array(F.collect_set("pattern")).alias("bogus"))
    rows = known.join(bogus, "id", "left")
    why = (
        F.when(F.col("sha") == "", "no commit")
        .when(F.col("seen").isNull(), "commit is gone")
        .when(F.array_contains("files", "-"), F.lit(None).cast("string"))
        .when(F.size("files") == 0, "no files")
        .when(F.col("bogus").isNotNull(), F.concat(F.lit("no such file: "), F.array_join("bogus", ", ")))
    )
    return rows.select("id", why.alias("why")).where("why IS NOT NULL")


def uncovered(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Paths that no section lists, by name or under the literal start of a glob."""
    return paths.join(matched(claims(found), paths.select("path").distinct()).select("path").distinct(), "path", "left_anti")


def oldest_stamp(found: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: the stamp furthest back in the log."""
    return found.select("sha").join(commits.select("sha", "ord"), "sha").agg(F.max_by("sha", "ord").alias("sha"), F.max("ord").alias("ord"))


def first_heading(docs: DataFrame, most_chars: int = 90, most_docs: int = 30) -> DataFrame:
    """``(path, heading)`` of Markdown files at most three levels deep."""
    md = docs.where(F.col("path").endswith(".md") & (F.size(F.split("path", "/")) <= 3))
    return md.select("path", F.substring(F.regexp_extract("content", r"(?m)^#{1,6}[ \t]+([^\n]*)", 1), 1, most_chars).alias("heading")).orderBy("path").limit(most_docs)


def added_since(uncovered_paths: DataFrame, added: DataFrame, since: DataFrame) -> DataFrame:
    """Uncovered paths that were added after the oldest stamp: ``added(path, ord)``, ``since`` the one row of ``oldest_stamp``."""
    later = added.crossJoin(F.broadcast(since.select(F.col("ord").alias("oldest")))).where("ord < oldest").select("path")
    return uncovered_paths.join(later, "path", "left_semi")


def missing_files(merged: DataFrame, paths: DataFrame, newest: int = 3) -> DataFrame:
    """``(id, path)``: files of the newest merged requests ``merged(id, at, path)`` that the working tree lacks."""
    last = merged.groupBy("id").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "id").limit(newest).select("id")
    return merged.join(F.broadcast(last), "id").select("id", "path").distinct().join(paths.select("path"), "path", "left_anti")

"""Commit history: churn, authors, recency."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def author_pattern(author: str) -> str:
    """A case-insensitive pattern; text that isn't one stands for itself."""
    try:
        re.compile(author)
        return "(?i)" + author
    except re.error:
        return "(?i)" + re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", author)


def churn(commits: DataFrame, commit_files: DataFrame, author: str | None = None) -> DataFrame:
    """``(path, churn, my_churn, last_touch, authors)`` from ``commits(ord, sha, at, author)``, newest first by ``ord``, and ``commit_files(sha, path)``.

    ``last_touch`` is the author time of the newest commit in log order, not the largest time. One aggregation with map-side combining.
    """
    mine = F.coalesce(F.col("author").cast("string").rlike(author_pattern(author)), F.lit(False)) if author else F.lit(False)
    rows = commit_files.select("sha", "path").distinct().join(commits, "sha")
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("churn"), F.count_if(mine).alias("my_churn"), F.min_by("at", "ord").alias("last_touch"), F.sort_array(F.collect_set("author")).alias("authors"))


def of_tracked(commit_files: DataFrame, files: DataFrame) -> DataFrame:
    """Touches of files that are tracked now; others are no part of the history that counts."""
    return commit_files.join(files.select("path"), "path", "left_semi")


def churny_unparsed(files: DataFrame, least: int = 3, most: int = 40) -> DataFrame:
    """Files without counted lines that more than ``least`` commits touched, most churn first, then in their order."""
    return files.where((F.col("loc") == 0) & (F.col("churn") > least)).orderBy(F.desc("churn"), "ord").limit(most)


def iso_date(epoch: Column) -> Column:
    """UTC day of epoch seconds, as text; null stays null."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def touched_most(commit_files: DataFrame, most: int = 20) -> DataFrame:
    return commit_files.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(most)


def most_active_author(commits: DataFrame) -> DataFrame:
    """One row ``(author, n)``: most commits, then the smallest name."""
    return commits.groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author").limit(1)


def mine_top(churned: DataFrame, most: int = 15) -> DataFrame:
    return churned.where(F.col("my_churn") > 0).orderBy(F.desc("my_churn"), "path").limit(most)


# What tools leave in a working tree without anyone's doing.
NOISE = tuple("node_modules/ dist/ build/ .next/ package-lock.json yarn.lock pnpm-lock.yaml .DS_Store".split())


def without_noise(status: DataFrame) -> DataFrame:
    """Working-tree rows without lock files and build output."""
    return status.where(~F.col("path").rlike("|".join(n.replace(".", r"\.") for n in NOISE)))

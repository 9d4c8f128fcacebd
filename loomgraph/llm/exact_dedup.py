"""Exact dedup with a heavy-hitter split, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty. Six byte searches beat one regular expression."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_groups(docs: DataFrame, support: float = 0.001, with_length: bool = False) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs(doc_id, text)``.

    Texts are equal when their normalised forms have the same SHA-256. Of equal texts the row with the most code points
    in the original text stays, then the smallest doc_id (null last); of rows with the same id and length
    exactly one. Null text counts as empty. ``with_length`` adds the row's own code points as ``length``.

    Texts are read once; digests are written to the shared folder. Misra-Gries counters (``freqItems``, at most
    ``1 / support`` of them) name every digest that more than ``support`` of all rows have. Their exact winners and
    sizes are aggregated with map-side combining, and that table, bounded by ``1 / support`` rows, is broadcast: rows of heavy
    digests are settled where they lie. Other digests are shuffled: their groups are aggregated with map-side combining, those of
    more than one row are written, and rows are joined with them, a join that the adaptive skew join splits. A row without a group is one by itself.
    An empty table gives an empty table; columns other than doc_id and text are ignored.
    """
    text_sha256 = F.sha2(normalised(F.col("text")), 256).alias("text_sha256")
    # the row numbers are stored, so they stay the same however often the table is read
    digests = written(docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), text_sha256, F.monotonically_increasing_id().alias("row")), "digests")
    candidates = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    candidates = written(candidates.distinct(), "candidates")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    heavy = digests.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    # candidates that turn out rare stay in the ordinary path, as do those with one row
    heavy = written(heavy.where("group_size > 1"), "heavy")
    discard(candidates)
    light = digests.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = written(light.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    marked = digests.join(F.broadcast(heavy), "text_sha256", "left")
    settled, rest = marked.where("group_size IS NOT NULL"), marked.where("group_size IS NULL").drop("best", "group_size").join(groups, "text_sha256", "left")
    out = settled.unionByName(rest)
    alone = F.col("group_size").isNull()
    keep_id, kept = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")), alone | (F.col("row") == F.col("best.row"))
    length = [F.col("n").cast("long").alias("length")] if with_length else []
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(kept, F.lit(True)).alias("kept"), "text_sha256", *length)

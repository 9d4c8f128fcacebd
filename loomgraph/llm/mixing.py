"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``.

    Sources in the order of their code points, null last, weigh ``weights`` in turn. Their targets share
    ``total_share`` of all sizes by weight, none above ``cap`` times its source's size, the excess going to the
    others by weight. With sources in the order of cap over weight, the ones up to some place are capped and the rest
    share what is left, so one running sum finds the level. This window holds one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int"))
    s = by_source.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(total_share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    s = s.withColumn("level", level)
    # the first source whose cap lies above the level fixes it for all that follow
    fixed = F.min(F.when(F.col("most") / F.col("w") >= F.col("level"), F.struct(F.col("most") / F.col("w"), "level"))).over(everything)["level"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("most"), F.coalesce(fixed * F.col("w"), F.col("most"))))
    return s.select("source", "source_size", target.alias("target"))


def _small_hash(c: Column) -> Column:
    """32 bits of md5 as a long; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, rows: int, weights: Sequence[float] = (3, 1, 2), total_share: float = 1.5, cap: float = 2.0, seed: str = "mix", bucket_rows: int = 2_000) -> DataFrame:
    """Adds size, source_size, target and copies to ``(doc_id, source, size)`` rows.

    A document of a source is expected ``target / source_size`` times, at most ``cap``. Documents of a source lie in
    the order of their size class (bit length), a bucket by a hash of doc_id and size, their size and doc_id; a document is emitted once for
    each integer that the running sum of expected copies, plus one offset for each source, crosses. Because the order
    goes by size, the words taken stay within about one document of the target. The running sum is the place times
    the rate, so the place alone is needed: counts are summed up over the classes of a source and over the buckets of a class, and rows are
    numbered inside their own bucket only. ``rows`` (the row count) sets the number of buckets, about ``bucket_rows``
    rows each, so that a source with most rows, or a doc_id that many rows of different sizes share, is spread over many tasks. Null sources make a source of their own,
    null doc_ids come first, tied rows are interchangeable, documents without words are never taken.
    """
    buckets = max(1, -(-rows // bucket_rows))
    d = docs.select("doc_id", "source", F.col("size").cast("long").alias("size"))
    d = d.withColumn("class", F.length(F.bin("size"))).withColumn("bucket", _small_hash(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("size").cast("string"))) % buckets)
    key = ["source", "class", "bucket"]
    counts = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda *by: F.coalesce(F.sum("n").over(before(*by)), F.lit(0))
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n")).withColumn("class_start", sum_before("source", "class")).drop("n")
    targets = source_targets(counts, weights, total_share, cap)
    of_source = classes.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "source_size", "target")
    starts = counts.withColumn("inside", sum_before("source", "class", "bucket"))
    same_class = F.col("s.source").eqNullSafe(F.col("o.source")) & (F.col("s.class") == F.col("o.class"))
    start = (F.col("class_start") + F.col("inside")).alias("start")
    plan = starts.alias("s").join(of_source.alias("o"), same_class).select("s.source", "s.class", "bucket", start, "source_size", "target")
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    # 16 bits, so that adding whole numbers to it is exact
    plan = plan.withColumn("offset", (_small_hash(F.concat(F.lit(seed + "/"), F.coalesce("source", F.lit("\x00")))) % 65536) / F.lit(65536.0))
    on = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.class") == F.col("p.class")) & (F.col("d.bucket") == F.col("p.bucket"))
    j = d.alias("d").join(plan.alias("p"), on).select("d.*", "start", "source_size", "target", "rate", "offset")
    place = F.col("start") + F.row_number().over(Window.partitionBy(*key).orderBy("size", F.col("doc_id").asc_nulls_first()))
    j = j.withColumn("place", place)
    crossed = F.floor(F.col("offset") + F.col("place") * F.col("rate")) - F.floor(F.col("offset") + (F.col("place") - 1) * F.col("rate"))
    copies = F.when(F.col("size") > 0, F.least(crossed, F.ceil(F.lit(float(cap))))).otherwise(F.lit(0)).cast("long")
    return j.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def with_size(docs: DataFrame) -> DataFrame:
    """Adds size: the number of words of the text, 0 for null. A column of that name is replaced; rows, null and repeated ids included, stay as they are."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))

"""Importance, z-scores, the hotspot score and why a file ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weights of the score's terms and the scale of recency in days.
WEIGHTS = {"importance": 1.2, "churn": 1.0, "complexity": 0.8, "recency": 0.6, "yours": 0.5}
RECENCY_DAYS = 45


def damped(rank: Column, loc: Column, fan_in: Column) -> Column:
    """Rank damped by substance and by the number of importers; 0 without importers."""
    loc, fan_in = F.coalesce(loc, F.lit(0)), F.coalesce(fan_in, F.lit(0))
    return F.coalesce(rank, F.lit(0.0)) * (0.25 + 0.75 * loc / (loc + 60)) * fan_in / (fan_in + 4)


def with_z(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``z_<column>``: distance from the mean in population standard deviations, missing values counting as 0, no spread as 1.

    The means are one row from one aggregation, broadcast; a window over everything would put all rows into one task.
    """
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    stats = rows.agg(*[a for c in columns for a in (F.avg(filled[c]).alias(f"_m_{c}"), F.stddev_pop(filled[c]).alias(f"_s_{c}"))])
    spread = {c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in columns}
    z = {f"z_{c}": (filled[c] - F.col(f"_m_{c}")) / spread[c] for c in columns}
    return rows.crossJoin(F.broadcast(stats)).withColumns(z).drop(*stats.columns)


def recency(last_touch: Column, as_of: Column) -> Column:
    """Decays from 1 at ``as_of`` (both in epoch seconds); 0 if never touched."""
    return F.coalesce(F.exp(-(as_of - last_touch) / F.lit(RECENCY_DAYS * 86400.0)), F.lit(0.0))


def hotspots(files: DataFrame, as_of: Column) -> DataFrame:
    """Adds the terms, ``score`` and ``why`` to ``(rank, loc, fan_in, churn, complexity, max_depth, last_touch, my_churn)`` rows."""
    f = files.withColumn("damped", damped(F.col("rank"), F.col("loc"), F.col("fan_in")))
    f = f.withColumn("cx", F.coalesce("complexity", F.lit(0)) * (1 + F.coalesce("max_depth", F.lit(0)) / 10))
    f = with_z(f, ["damped", "churn", "cx"]).withColumn("recency", recency(F.col("last_touch"), as_of))
    terms = {
        "importance": F.lit(WEIGHTS["importance"]) * F.col("z_damped"),
        "churn": F.lit(WEIGHTS["churn"]) * F.col("z_churn"),
        "complexity": F.lit(WEIGHTS["complexity"]) * F.col("z_cx"),
        "recency": F.lit(WEIGHTS["recency"]) * F.col("recency"),
        "yours": F.when(F.coalesce("my_churn", F.lit(0)) > 0, F.lit(WEIGHTS["yours"])).otherwise(F.lit(0.0)),
    }
    f = f.withColumns({f"term_{k}": v for k, v in terms.items()})
    score = reduce(lambda a, b: a + b, [F.col(f"term_{k}") for k in terms])
    return f.withColumn("score", score).withColumn("why", why(*[F.col(f"term_{k}") for k in ("importance", "churn", "complexity", "recency")]))


def why(importance: Column, churn: Column, complexity: Column, recent: Column) -> Column:
    """The label of the largest term, the earlier one on ties; a dash if none is above 0."""
    top = F.greatest(importance, churn, complexity, recent)
    return F.when(top <= 0, "—").when(importance == top, "depended-on").when(churn == top, "churn").when(complexity == top, "complex").otherwise("recent")

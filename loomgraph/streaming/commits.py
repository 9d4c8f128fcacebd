"""Churn and staleness over commits that keep arriving, one trigger at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "sha string, path string, at timestamp, author string"


def touched(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """A stream of touched files from Parquet files that land in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def running_churn(stream: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Touches of each file by event-time window; the watermark bounds the state."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window), "path").agg(F.count(F.lit(1)).alias("churn"), F.approx_count_distinct("author").alias("authors"))


def stale_on_arrival(stream: DataFrame, claims: DataFrame) -> DataFrame:
    """``(id, path, sha)``: touches of claimed files after their section's stamp, by a join with the static ``claims(id, path, stamped_at)``."""
    return stream.join(claims, "path").where(F.col("at") > F.col("stamped_at")).select("id", "path", "sha")


def run_available(frame: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; each batch goes to ``sink(batch, number)`` once, also after a restart."""
    return frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()

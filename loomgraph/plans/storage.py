"""Where loops and plans put intermediate tables."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode with the setting unset."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="loomgraph-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = posixpath.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def counted(df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """The written table and how many rows it has, or for how many ``what`` holds, counted by the job that writes it.

    A stage that runs again after a lost executor may count rows twice, so this is good for bounds and for whether there are any.
    """
    seen = Observation()
    out = written(df.observe(seen, (F.count(F.lit(1)) if what is None else F.count_if(what)).alias("n")), name)
    return out, int(seen.get.get("n") or 0)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``written`` that no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Shared folders, written tables and label samples used by the operators."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, for Java regular expressions.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode with the setting unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def settled(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, for frames that no one runs again: the shuffle files of the write go with its end, not with the driver's next garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = df.sparkSession.conf.get(key, None)
    df.sparkSession.conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        df.sparkSession.conf.set(key, before) if before is not None else df.sparkSession.conf.unset(key)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``written`` that no later step reads."""
    for t in tables:
        jvm, context = t.sparkSession._jvm, t.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores behind it until no column of the frames is called so, in small or capital letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def row_key() -> Column:
    """A key of a document row: 128 bits of the SHA-256 of its doc_id and text, null or not; rows equal in both share it."""
    marked = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?"))
    return F.substring(F.unhex(F.sha2(F.concat(marked("doc_id"), F.lit("/"), marked("text")), 256)), 1, 16).alias("row_key")


def label_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, max_chars: int) -> DataFrame:
    """Labelled texts to fit a model on: ``(doc_id, text, y)``, at most ``per_class`` rows of either label.

    Rows are taken in the order of a hash of doc_id, so the sample is the same on every run. Only texts of at
    most ``max_chars`` code points are used for fitting, which bounds the driver's memory; scoring has no bound.
    The chosen ids (at most ``2 * per_class``) are broadcast. Null or other labels than 0 and 1 are left out.
    """
    usable = labels.where(keep & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    return texts.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, root)``, root being the smallest id; nodes without edges are absent.

    Hook-and-contract: every node hooks to its smallest neighbour, chains are shortened by pointer jumping, and the
    graph is contracted until no edge is left. Each round at least halves the nodes that have edges. Every round is
    written to the shared folder; nothing is gathered on the driver but the count of edges left.
    """
    live = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    found = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"), F.lit(True).alias("moved")), "parents")
        while not up.where("moved").isEmpty():
            top = up.select(F.col("id").alias("root"), F.col("root").alias("top"))
            jumped = written(up.join(top, "root").select("id", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "parents")
            discard(up)
            up = jumped
        if found is None:
            found = written(up.select("id", "root"), "labels")
        else:
            later = up.select(F.col("id").alias("root"), F.col("root").alias("top"))
            old, found = found, written(found.join(later, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "labels")
            discard(old)
        a = up.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        old, live = live, written(live.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        discard(old, up)
    discard(live)
    if found is None:
        kind = edges.schema["a"].dataType
        return written(edges.sparkSession.createDataFrame([], "id long, root long").select(F.col("id").cast(kind), F.col("root").cast(kind)), "labels")
    return found


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """At most so many rows and about so many bytes in a batch that goes to Python, so that long texts don't add up to more than a worker has.

    Spark reads both settings when a frame runs, so they stay set in the session; smaller ones of the user's are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key)).lower()
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))

"""The library's inputs as views of the driver's tables: files, commits, edges, specifiers and sections.

Each view exists twice, as a DataFrame and as a common table expression of the same meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import resolve
from ..sources.tables import table
from .storage import written

EXTENSIONS = (".ts", ".py", ".sql", ".js")


def files(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), ext).alias("path"), ext.alias("ext"), F.col("text").alias("content"))


FILES = "v_files AS (SELECT doc_id, 'src/' || source || '/' || lang || '/d' || doc_id || ['.ts', '.py', '.sql', '.js'][(doc_id % 4 + 1)::INT] AS path, ['.ts', '.py', '.sql', '.js'][(doc_id % 4 + 1)::INT] AS ext, text AS content FROM documents)"


def epoch(c: Column) -> Column:
    """Whole seconds since 1970 of a time stamp without a zone, read as UTC."""
    return F.unix_timestamp(c.cast("timestamp"))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """``(sha, path, at, author, subject)``: one file for each event."""
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("sha"), F.get_json_object("props", "$.k").cast("long").alias("path"), epoch(F.col("ts")).alias("at"), F.col("ts"), F.col("user_id").alias("author"), F.col("event_type").alias("subject"))


COMMITS = "v_commits AS (SELECT event_id AS sha, (props->>'$.k')::BIGINT AS path, floor(epoch(ts))::BIGINT AS sec, ts, user_id AS author, event_type AS subject FROM events)"


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """``(src, dst, is_value, is_lazy)``: a user's error followed by the next user's, as in ``EDGES``, through the library's ``resolve.edges``."""
    return resolve.edges(edge_rows(spark, folder)).drop("is_static")


def edge_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(src, dst, is_type, is_lazy)``, one row for each error event and the next in time.

    Events are dealt by ranges of time and looked ahead from inside each range; the last of a range takes the first of the next one that has any, from one
    small row of the first events of all ranges.
    """
    e = table(spark, folder, "events").where("event_type = 'error'").select("ts", "event_id", F.col("user_id").alias("src"))
    dealt = written(e.repartitionByRange("ts", "event_id").withColumn("part", F.spark_partition_id()), "dealt")
    firsts = dealt.groupBy("part").agg(F.min_by("src", F.struct("ts", "event_id")).alias("head"))
    firsts = firsts.agg(F.sort_array(F.collect_list(F.struct("part", "head"))).alias("heads"))
    following = F.lead("src").over(Window.partitionBy("part").orderBy("ts", "event_id"))
    rows = dealt.withColumn("inside", following).crossJoin(F.broadcast(firsts))
    later = F.get(F.filter("heads", lambda h: h["part"] > F.col("part")), F.lit(0))["head"]
    rows = rows.select("event_id", "src", F.coalesce("inside", later).alias("dst")).where("dst IS NOT NULL")
    return rows.select("src", "dst", (F.col("event_id") % 70 == 0).alias("is_type"), (F.col("event_id") % 30 == 0).alias("is_lazy"))


EDGES = """v_edges AS (SELECT src, dst, bool_or(event_id % 70 <> 0) AS is_value, bool_or(event_id % 30 = 0) AS is_lazy FROM
  (SELECT event_id, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'error')
  WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst), v_nodes AS (SELECT DISTINCT user_id AS id FROM events)"""


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("id")).distinct()

"""A training corpus from raw documents: toxicity, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup, mixing, packing, setsketch, toxicity
from loomgraph.llm.common import free_name, row_key, small_batches, table, written
from loomgraph.llm.queries import tokenizer_path

# What all stages have in common: a null or empty text is a document like any other, null and repeated doc_ids stay apart by their texts, columns beyond doc_id, text
# and source pass through whatever they are called, and an empty table gives an empty table.


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, fitted on the labels, doesn't reject. Documents without words stay; so does everything if no label is 1."""
    small_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts: the longest, then the smallest doc_id. Null, empty and blank texts are one group.

    The rows that stay are joined back by digest, length and doc_id; of rows equal in all three one stays.
    """
    mark = free_name("unique_key", docs)

    def key(sha256: Column, length: Column) -> Column:
        return F.concat_ws(":", sha256, length.cast("string"), F.col("doc_id").cast("string")).alias(mark)

    kept = exact_dedup.exact_groups(docs, with_length=True).where("kept")
    keep = written(kept.select(key(F.col("text_sha256"), F.col("length"))), "keep")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("*", key(F.sha2(exact_dedup.normalised(F.col("text")), 256), F.length(text)))
    return keyed.join(keep, mark, "left_semi").dropDuplicates([mark]).select(docs.columns)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard similarity of 5-word shingles 0.8 or more): the one with the smallest doc_id.

    Documents without words are near to nothing and stay. Of a group without any doc_id all stay.
    """
    mark = free_name("gone_key", docs)
    gone = setsketch.near_duplicates(docs, percent=80).where("NOT kept").select(F.col("row_key").alias(mark)).distinct()
    return docs.withColumn(mark, row_key()).join(written(gone, "gone"), mark, "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat, and documents taken zero times go. Wholly equal rows are taken equally often.

    Null sources are one source. Documents without words have size 0 and are never taken.
    """
    mark, copies, copy = (free_name(name, docs) for name in ("mix_key", "mix_copies", "mix_copy"))
    sizes = mixing.with_size(docs.select("doc_id", "text", "source")).select(F.struct("doc_id", row_key().alias("key")).alias("doc_id"), "source", "size")
    sizes = written(sizes, "sizes")
    taken = mixing.mix(sizes, sizes.count()).where("copies > 0").groupBy(F.col("doc_id.key").alias(mark)).agg(F.min("copies").cast("int").alias(copies))
    joined = docs.withColumn(mark, row_key()).join(written(taken, "taken"), mark)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; see ``packing.SCHEMA``. A document without text is its end token alone."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact_dedup", unique),
    ("near_dedup", apart),
    ("mixing", mixed),
    ("packing", packed),
]

#: Toxicity, near dedup and packing can't be expressed in SQL; a test recomputes every stage of run() row by row.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

"""The registered queries of the operators in this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, clusters, exact_dedup, mixing, packing, quality, repeats, setsketch, style_tree, toxicity, vectors, warc
from .common import small_batches, table, written


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings."""
    control = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat.chat_digests(chat.format_chats(rows.unionByName(more)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with how many of its words the mix takes; see ``mixing.mix``."""
    docs = table(spark, sf_dir, "documents")
    sizes = written(mixing.with_size(docs).select("doc_id", "source", "size"), "sizes")
    m = mixing.mix(sizes, sizes.count())
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; see ``style_tree.extract``."""
    small_batches(spark)
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to packaged archives and read back; see ``warc.round_trip``."""
    small_batches(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts; see ``exact_dedup.exact_groups``."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; see ``packing.pack``."""
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; see ``quality.quality_scores``."""
    small_batches(spark)
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near duplicates; see ``setsketch.near_duplicates``."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; see ``toxicity.toxicity_scores``."""
    small_batches(spark)
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links; see ``vectors.near_vectors``."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its groups of aligned tokens and its links' counts; see ``alignment.align``."""
    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *map(tokenizer_path, names))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 finite components with its cluster; see ``clusters.clusters``."""
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of passages that an earlier one holds; see ``repeats.without_repeats``."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat, op2_mixing, op3_html, op4_warc, op5_exact_dedup, op6_packing, op7_quality, op8_near_dedup, op9_toxicity, op10_vectors, op11_alignment, op12_clusters, op13_repeats)
    return {f.__name__: f for f in own}


OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), ranked AS (
  SELECT *, lag(role, 1, '') OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\|+)', '<|\1', 'g') || chr(10) || regexp_replace(text, '<(\|+)', '<|\1', 'g') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars,
  bool_and((before || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant', 'tool>tool')
    AND (from_end > 1 OR role = 'assistant')) AS valid
FROM ranked GROUP BY conv_id
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), n AS (SELECT greatest(1, ceil(count(*) / 2000.0))::BIGINT AS buckets FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT min(level) FILTER (most / w >= level) AS fixed FROM (SELECT *, min(most / w) FILTER (most / w >= level) OVER () AS q FROM o) WHERE most / w = q
), t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(most, coalesce(fixed * w, most)) END::DOUBLE AS target FROM o, f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    (('0x' || substr(md5('mix/' || coalesce(d.source, chr(0))), 1, 8))::BIGINT % 65536) / 65536.0::DOUBLE AS off,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '/' || d.size), 1, 8))::BIGINT % buckets, d.size, d.doc_id NULLS FIRST) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, n
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN least(floor(off + place * rate) - floor(off + (place - 1) * rate), 2) ELSE 0 END * size)::BIGINT AS taken FROM r
"""

OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id = page_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM w
"""

OP5 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM k
"""


def _op12(k: int = 16, rounds: int = 3) -> str:
    """The rounds of ``clusters`` written out: assignment a and centroids c of each."""
    near = "SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT vec_id, k, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n} c) GROUP BY vec_id"
    mean = "SELECT k, list(m ORDER BY i) AS q FROM (SELECT k, i, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT a.k, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM a{n} a JOIN v USING (vec_id)) GROUP BY k, i) GROUP BY k"
    out = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, q FROM v QUALIFY k < """ + f"{k})"
    for n in range(rounds):
        out += f",\na{n} AS ({near.format(n=n)}), m{n} AS ({mean.format(n=n)}), c{n + 1} AS (SELECT k, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN m{n} m USING (k))"
    return out + f""",\na{rounds} AS ({near.format(n=rounds)})
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
x AS (SELECT doc_id, p, n, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS span FROM t),
g AS (SELECT doc_id, p, word, p + 12 <= n AND min(doc_id) OVER (PARTITION BY span, p + 12 <= n) < doc_id AS starts FROM x),
k AS (SELECT doc_id, p, word, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM g),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1, "op2_mixing": OP2, "op4_warc": OP4, "op5_exact_dedup": OP5, "op12_clusters": _op12(), "op13_repeats": OP13}

"""The queries of the numbered operators, thin over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotrain, htmlmain, langid, lm, lzprint, mixing, negatives, quality_rules, simhash, topk, warc, whitening
from .common import new_path, save, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmlmain.extract(pages, htmlmain.fit(pages))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_held_out(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = save(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words("text").alias("size")), "sizes")
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotrain.score(docs, cotrain.fit(docs, table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    warc.archive(warc.page_records(table(spark, sf_dir, "pages")), path)
    back = warc.resolved(warc.read(spark, path))
    return back.select(warc.page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id_of("refers_to").alias("refers_to"))


def op11_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.by_next(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = topk.integer_vectors(rows.withColumn("label", label), more=["label"])
    return negatives.mine(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_text": op2_html_text,
    "op3_top_k": op3_top_k,
    "op4_simhash": op4_simhash,
    "op5_lm_scores": op5_lm_scores,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_cotraining": op9_cotraining,
    "op10_warc": op10_warc,
    "op11_lz_fingerprints": op11_lz_fingerprints,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op13_hard_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS is_same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE is_same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM p JOIN s USING (anchor_id)
    WHERE NOT s.is_same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op10_warc": """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 1000""",
    "op3_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_mixing": """
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS w,
           source_size * 2.0::DOUBLE AS most
    FROM s
), l AS (
    SELECT *, most / w AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS spend FROM w
), v AS (
    SELECT *, (spend - coalesce(sum(most) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM l
), t AS (
    SELECT source, source_size,
           CASE WHEN source_size = 0 THEN 0.0 ELSE least(most, max(CASE WHEN level <= full_at THEN level END) OVER () * w) END AS target
    FROM v
), u AS (
    SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * 4294967296.0::DOUBLE) AS HUGEINT) ELSE 0 END AS units,
           CAST('0x' || substr(md5('42|' || coalesce(d.source, chr(0) || 'null')), 1, 8) AS BIGINT) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
    SELECT *, start + sum(units) OVER (PARTITION BY source ORDER BY size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM u
), c AS (
    SELECT *, CAST(upto // 4294967296 - (upto - units) // 4294967296 AS BIGINT) AS copies FROM e
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, copies * size AS taken, source, copies FROM c""",
}

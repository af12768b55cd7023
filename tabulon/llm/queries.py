"""The registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, conversation_repair, digest_index, embedding_dedup, filter_audit, language, license_rules, mixing, ngram_join, order_minhash, quality, quotation, toxicity
from tabulon.llm.training import fold_of

#: The vocabulary file of op6; a folder that every driver has.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Shares of expected tokens by domain for op8: the quality that ``labels`` marks.
MIX_WEIGHTS = {"high": 0.9, "low": 0.1}
#: From this score on a document counts as toxic, or as good.
TOXIC_FROM = 0.3
GOOD_FROM = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from labels outside the held-out fold (crc32 of the id modulo 4 is 2)."""
    return toxicity.fit_toxicity(docs, labels.where(fold_of("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("target")))


def op1_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, name="score").select(
        "doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit_language(docs.select("doc_id", "text", "lang").where(fold_of("doc_id", 5) != 0))
    return language.predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score"
    )


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = _table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0)
    model = quality.fit_quality(docs, labels.select("doc_id", F.col("quality").alias("target")))
    return quality.score_quality(docs, model, name="score").select(
        "doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"),
    )


def op4_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link_quotations(_table(spark, sf_dir, "conversations"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, bpe.build_codec(docs, VOCABULARY))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), words=3, percent=90)


def mixing_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain")).where("domain IS NOT NULL")


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mixing_rates(docs, mixing_labels(_table(spark, sf_dir, "labels")), MIX_WEIGHTS)


def op9_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index, which is dropped again."""
    index = digest_index.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    try:
        return digest_index.deduplicate(_table(spark, sf_dir, "documents"), index)
    finally:
        index.drop()


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage by crc32 of ``conv_id:turn``, then repair; conversations that lost every row too."""
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair_digests(conversation_repair.damage(rows), rows.select("conv_id"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filter_audit.flag_documents(_table(spark, sf_dir, "documents"))
    return filter_audit.audit_filters(docs, _table(spark, sf_dir, "labels"))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = order_minhash.fingerprint_edits(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.fingerprint_text(F.col("slots")).alias("fingerprint"),
        order_minhash.fingerprint_text(F.col("edited_slots")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
        order_minhash.likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )


QUERIES = {
    "op1_toxicity_ftrl": op1_toxicity_ftrl,
    "op2_language_id": op2_language_id,
    "op3_quality_fm": op3_quality_fm,
    "op4_embedding_pq": op4_embedding_pq,
    "op5_quotation_linking": op5_quotation_linking,
    "op6_bpe_transducer": op6_bpe_transducer,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_soft_mixing": op8_soft_mixing,
    "op9_digest_index": op9_digest_index,
    "op10_license_rules": op10_license_rules,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_order_minhash": op13_order_minhash,
}

_DIGESTS = """
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
        sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

_NEAR_VECTORS = """
    WITH RECURSIVE v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
        AND len([x FOR x IN embedding IF x <> 0]) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
    reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN n ON vec_id = n.a
"""

SQL = {
    "op4_embedding_pq": _NEAR_VECTORS,
    "op9_digest_index": _DIGESTS,
    "op10_license_rules": license_rules.oracle_sql(),
    "op12_filter_audit": filter_audit.ORACLE,
}

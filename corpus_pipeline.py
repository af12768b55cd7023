"""The corpus pipeline: STAGES applied in order to documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import values as vx
from tabulon.llm import bpe, digest_index, mixing, queries, toxicity
from tabulon.llm.ngram_join import drop_near_copies
from tabulon.session import shared_folder

#: Near-duplicate stage: words in a shingle and the least Jaccard similarity in percent.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
#: Mixing stage: documents of low quality should keep half their share of the tokens.
MIX_RELATIVE = {"high": 1.0, "low": 0.5}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labelled ones.

    Without labels to learn from (none at all, all held out, or of no document here), or with
    too few to give any feature a weight, all texts have the same score, which says nothing
    about any of them: all documents stay, with a warning.
    """
    model = queries.toxicity_model(docs, _labels(spark, sf_dir))
    if model.blind:
        warnings.warn("toxicity stage: nothing learned from the labels, all documents are kept", stacklevel=2)
        return docs
    scored = toxicity.score_toxicity(docs, model, name="__toxic")
    return scored.where(F.col("__toxic") < queries.TOXIC_FROM).drop("__toxic")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, by a digest index made for this run."""
    index = digest_index.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    try:
        return digest_index.drop_copies(docs, index)
    finally:
        index.drop()


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Texts that share an id are decided one by one.
    """
    return drop_near_copies(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in which the low-quality domain has half its share, and no document repeats."""
    labels = queries.mixing_labels(_labels(spark, sf_dir))
    model, _ = mixing.fit_mixing(docs, labels, MIX_RELATIVE, repeat=False, relative=True)
    return mixing.mix(docs, model)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its ids and their number; its text is what the ids decode to.

    Columns ``ids`` and ``n_tokens`` that the documents bring along are replaced.
    """
    codec = bpe.build_codec(docs, queries.VOCABULARY)
    coded = bpe.round_trip(docs, codec, ids="__ids", decoded="__decoded")
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    columns = [F.col("__decoded").alias("text") if c == "text" else vx.ref(c) for c in kept]
    return coded.select(*columns, F.size("__ids").cast("long").alias("n_tokens"), F.col("__ids").alias("ids"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL has no classifier, fit or byte-pair merges; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages' results lie in the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs

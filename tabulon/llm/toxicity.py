"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, word stems (prefixes, for inflected and compound words), pairs of
neighbours and pairs with one word between, each counted once per text. The L1 penalty
leaves few weights, which are broadcast as (place, weight) pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import ftrl
from tabulon.llm.texthash import LETTERS, Words, blocks, mix, owners
from tabulon.llm.training import bounded_sample, feature_rows, sample_texts, scored
from tabulon.llm.workers import prepare

PLACES = 1 << 18
STEMS = (4, 5, 6, 8, 10)
#: Labelled rows to learn from, at most.
SAMPLE_ROWS = 12_000
RATES = ftrl.Rates(alpha=0.3, beta=1.0, l1=1.5, l2=0.1, rounds=4)
_NEXT = np.uint64(0x9E3779B97F4A7C15)
_SKIP = np.uint64(0xC2B2AE3D27D4EB4F)


def _features(words: Words):
    """(text number, place) arrays, one pair per kind of feature."""
    h, bounds = words.hashes(), words.bounds
    own = owners(words.counts())
    mask = np.uint64(PLACES - 1)
    yield own, (h & mask).astype(np.int64)
    for size in STEMS:
        stem = words.prefixes(size)
        longer = np.flatnonzero(stem)
        yield own[longer], (mix(stem[longer]) & mask).astype(np.int64)
    for gap, salt in ((1, _NEXT), (2, _SKIP)):
        near = np.flatnonzero(own[gap:] == own[:-gap]) if len(own) > gap else np.zeros(0, np.int64)
        yield own[near], (mix(h[near] * salt + h[near + gap]) & mask).astype(np.int64)


def _example_features(column: pa.Array):
    for _, _, data, offsets in blocks(column):
        parts = list(_features(Words(data, offsets, LETTERS)))
        own, place = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        pairs = np.unique(own * PLACES + place)
        cuts = np.searchsorted(pairs, np.arange(len(offsets)) * PLACES)
        for d in range(len(offsets) - 1):
            index = pairs[cuts[d] : cuts[d + 1]] % PLACES
            yield index, np.ones(len(index), np.float32)


@dataclass(frozen=True)
class ToxicityModel:
    """The weights that are not zero."""

    places: np.ndarray
    values: np.ndarray
    bias: float

    @property
    def blind(self) -> bool:
        """No feature has a weight, so all texts get one score."""
        return not len(self.places)

    def scorer(self, spark):
        """Arrow texts to probabilities; the weights go by broadcast."""
        shared = spark.sparkContext.broadcast((self.places, self.values, self.bias))

        def score(column: pa.Array) -> pa.Array:
            places, values, bias = shared.value
            table = np.zeros(PLACES)
            table[places] = values
            used = table != 0
            out = np.zeros(len(column))
            for lo, hi, data, offsets in blocks(column):
                pairs = []
                for own, place in _features(Words(data, offsets, LETTERS)):
                    hit = np.flatnonzero(used[place])
                    pairs.append(own[hit] * PLACES + place[hit])
                pairs = np.unique(np.concatenate(pairs))
                margin = bias + np.bincount(pairs // PLACES, table[pairs % PLACES], hi - lo)
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            return pa.array(out)

        return score


def fit_toxicity(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS, rates: ftrl.Rates = RATES,
) -> ToxicityModel:
    """Learn from ``labelled`` (id, target 0 or 1), at most about ``sample_rows`` of its rows.

    Null ids and targets are left out; an id with several labels takes the largest. Without
    labelled rows the model knows nothing and scores 0.5.
    """
    prepare(docs.sparkSession)
    labels = labelled.where(F.col(id_col).isNotNull() & F.col("target").isNotNull())
    labels = labels.groupBy(id_col).agg(F.max("target").cast("int").alias("target"))
    texts = sample_texts(docs, bounded_sample(labels, id_col, sample_rows), id_col, text_col)
    rows = feature_rows(texts, _example_features)
    w = ftrl.fit(rows, PLACES, 1, rates)[:, 0]
    places = np.flatnonzero(w[:-1])
    return ToxicityModel(places, w[places], float(w[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """``docs`` with a probability; null and empty texts get the score of no feature at all."""
    prepare(docs.sparkSession)
    return scored(docs, model.scorer(docs.sparkSession), [text_col], name, "double")

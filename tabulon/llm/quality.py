"""Quality: a factorisation machine over hashed words, structure and metadata.

score = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, where the pair term is
0.5 * sum over factors of (sum v x)^2 - sum (v x)^2, linear in the number of features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.texthash import NOT_SPACE, Words, blocks, byte_table
from tabulon.llm.training import bounded_sample, feature_rows, sample_texts, scored, train_rounds
from tabulon.llm.workers import prepare

WORD_PLACES = 1 << 13
FACTORS = 8
BINS = 16
SAMPLE_ROWS = 12_000
ROUNDS = 4
STEP = 0.1
SHRINK = 1e-5

_UPPER = byte_table(lambda b: 65 <= b <= 90)
_DIGIT = byte_table(lambda b: 48 <= b <= 57)
_MARK = byte_table(lambda b: b < 0x80 and b > 32 and not chr(b).isalnum())
_STOP = byte_table(lambda b: chr(b) in ".!?,;:")
_LINE = byte_table(lambda b: b == 10)
_HIGH = byte_table(lambda b: b >= 0x80)
_KINDS = (_UPPER, _DIGIT, _MARK, _STOP, _LINE, _HIGH)
#: Bytes, words, mean word length, six shares of bytes, distinct words, repeats of the word
#: before, share of the commonest word, words ending in two marks, and n_chars.
STATISTICS = 3 + len(_KINDS) + 4 + 1
PLACES = WORD_PLACES + STATISTICS * BINS


def _share_bins(share: np.ndarray) -> np.ndarray:
    """16 bins of a share in [0, 1], finer near 0."""
    return np.minimum((np.sqrt(np.clip(share, 0, 1)) * BINS).astype(np.int64), BINS - 1)


def _size_bins(size: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(size, 0) + 1).astype(np.int64), 0, BINS - 1)


def features(column: pa.Array, lengths: pa.Array):
    """(places, values) of each text: hashed words with log counts of norm 1, and one bin per statistic."""
    given = np.nan_to_num(np.asarray(lengths.cast(pa.float64()).fill_null(0.0)), posinf=0.0, neginf=0.0)
    for lo, hi, data, offsets in blocks(column):
        words = Words(data, offsets, NOT_SPACE)
        counts, bounds, n = words.counts(), words.bounds, np.diff(offsets)
        h = words.hashes()
        places = (h >> np.uint64(64 - 13)).astype(np.int64)
        size = words.end - words.start
        total = lambda flags, at: np.diff(np.concatenate(([0], np.cumsum(flags)))[at])
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[bounds[:-1][counts > 0]] = False
        marked = _MARK[data[words.end - 1]] & _MARK[data[np.maximum(words.end - 2, 0)]] & (size > 2) if len(h) else same
        many, long = np.maximum(counts, 1), np.maximum(n, 1)
        bins = [_size_bins(n), _size_bins(counts), np.minimum(total(size, bounds) // many, BINS - 1)]
        bins += [_share_bins(total(kind[data], offsets) / long) for kind in _KINDS]
        bins += [_share_bins(total(same, bounds) / many), _share_bins(total(marked, bounds) / many), _size_bins(given[lo:hi])]
        fixed = np.stack(bins, 1)
        for d in range(hi - lo):
            held = np.bincount(places[bounds[d] : bounds[d + 1]], minlength=WORD_PLACES)
            at = np.flatnonzero(held)
            value = 1 + np.log(held[at])
            value /= max(1e-9, float(np.sqrt((value * value).sum())))
            most = held.max() / many[d]
            bin_of = np.concatenate((fixed[d], _share_bins(np.array([len(at) / many[d], most]))))
            extra = WORD_PLACES + np.arange(STATISTICS) * BINS + bin_of
            yield np.concatenate((at, extra)), np.concatenate((value, np.ones(STATISTICS)))


def margin(index: np.ndarray, value: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float):
    """The machine's margin and the factor sums."""
    scaled = v[index] * value[:, None]
    sums = scaled.sum(0)
    return bias + value @ w[index] + 0.5 * float((sums * sums).sum() - (scaled * scaled).sum()), sums


def _learn(state, indices, values, targets):
    """One pass of AdaGrad; columns: w, factors, then their squared gradients. The last row is the bias."""
    k = FACTORS
    for index, value, target in zip(indices, values, targets):
        index, value = np.asarray(index, np.int64), np.asarray(value, np.float64)
        got, sums = margin(index, value, state[:, 0], state[:, 1 : k + 1], state[-1, 0])
        error = 1 / (1 + np.exp(-np.clip(got, -35, 35))) - target
        own = state[index, : k + 1]
        slope = np.empty((len(index), k + 1))
        slope[:, 0] = value
        slope[:, 1:] = value[:, None] * sums - own[:, 1:] * (value * value)[:, None]
        g = error * slope + SHRINK * own
        seen = state[index, k + 1 :] + g * g
        state[index, k + 1 :] = seen
        state[index, : k + 1] = own - STEP * g / np.sqrt(seen + 1e-8)
        state[-1, k + 1] += error * error
        state[-1, 0] -= STEP * error / np.sqrt(state[-1, k + 1] + 1e-8)


@dataclass(frozen=True)
class QualityModel:
    linear: np.ndarray
    factors: np.ndarray
    bias: float

    def scorer(self, spark):
        shared = spark.sparkContext.broadcast((self.linear, self.factors, self.bias))

        def score(column: pa.Array, lengths: pa.Array) -> pa.Array:
            w, v, bias = shared.value
            got = np.array([margin(i, x, w, v, bias)[0] for i, x in features(column, lengths)], np.float64)
            return pa.array(1 / (1 + np.exp(-np.clip(got, -35, 35))))

        return score


def fit_quality(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    length_col: str = "n_chars", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS,
) -> QualityModel:
    """Learn from ``labelled`` (id, target 0 or 1), at most about ``sample_rows`` of its rows.

    Null ids and targets are left out; an id with several labels takes the least. Without
    labelled rows the model is the starting point, close to 0.5.
    """
    prepare(docs.sparkSession)
    labels = labelled.where(F.col(id_col).isNotNull() & F.col("target").isNotNull())
    labels = labels.groupBy(id_col).agg(F.min("target").cast("int").alias("target"))
    sample = bounded_sample(labels, id_col, sample_rows)
    texts = sample_texts(docs.withColumn(text_col, F.struct(F.col(text_col).alias("body"), F.col(length_col).cast("double").alias("given"))), sample, id_col, text_col)
    texts = texts.select(F.col("text.body").alias("text"), F.col("text.given").alias("given"), "target", "shard", "rank")
    rows = feature_rows(texts, features, ("given",))
    state = np.zeros((PLACES + 1, 2 * (FACTORS + 1)))
    state[:PLACES, 1 : FACTORS + 1] = np.random.default_rng(7).normal(0, 0.02, (PLACES, FACTORS))
    state = train_rounds(rows, state, _learn, rounds)
    return QualityModel(state[:PLACES, 0].copy(), state[:PLACES, 1 : FACTORS + 1].copy(), float(state[-1, 0]))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", length_col: str = "n_chars", name: str = "quality_score") -> DataFrame:
    """``docs`` with a probability of good quality; null texts count as empty, null lengths as 0."""
    prepare(docs.sparkSession)
    return scored(docs, model.scorer(docs.sparkSession), [text_col, length_col], name, "double")

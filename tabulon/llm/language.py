"""Language identification: sparse multinomial regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with an elastic net (L1 and L2), calibrated by one
temperature. Document frequencies come from every text one may learn from; the regression
learns from a bounded sample with about the same number of texts per language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import ftrl
from tabulon.llm.texthash import blocks
from tabulon.llm.training import feature_rows, sample_texts, scored
from tabulon.llm.workers import prepare

PLACES = 1 << 14
ORDERS = (1, 2, 3)
#: Texts per language to learn from, at most about.
SAMPLE_PER_LANGUAGE = 1_500
RATES = ftrl.Rates(alpha=0.5, beta=1.0, l1=0.02, l2=0.01, rounds=3)
#: Every tenth sampled text only serves to choose the temperature.
CALIBRATION_PART = 10
TEMPERATURES = [round(0.05 * 1.12**k, 4) for k in range(48)]
UNKNOWN = "und"
_SALTS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - 14)


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all else."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def gram_counts(column: pa.Array):
    """Counts of hashed character n-grams of each text; None if it has no letter.

    Letters are lower-cased, each run of other characters is one gap.
    """
    for _, _, data, offsets in blocks(column):
        first = (data & 0xC0) != 0x80
        ends = np.concatenate(([0], np.cumsum(first)))[offsets]
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        chars = _letters()[points].astype(np.uint64)
        kept = np.ones(len(chars), bool)
        kept[1:] = (chars[1:] != 0) | (chars[:-1] != 0)
        starts = ends[:-1][ends[:-1] < len(chars)]
        kept[starts] = True
        ends = np.concatenate(([0], np.cumsum(kept)))[ends]
        chars = chars[kept]
        hashed = []
        for order in ORDERS:
            total = np.zeros(max(0, len(chars) - order + 1), np.uint64)
            for k in range(order):
                total += chars[k : len(chars) - order + 1 + k] * _SALTS[k]
            total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * order)
            hashed.append((total >> _SHIFT).astype(np.int64))
        for a, b in zip(ends[:-1], ends[1:]):
            if not chars[a:b].any():
                yield None
            else:
                yield np.bincount(np.concatenate([h[a : max(a, b - o + 1)] for o, h in zip(ORDERS, hashed)]), minlength=PLACES)


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    return at, value / np.sqrt((value * value).sum())


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts that hold each n-gram, and texts with a letter; one row per task and n-gram is shuffled."""
    def run(batches):
        held, n = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            for counts in gram_counts(batch.column(0)):
                if counts is not None:
                    held += counts > 0
                    n += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], n))], ["place", "held"])

    table = texts.mapInArrow(run, "place long, held long").groupBy("place").agg(F.sum("held").alias("held")).toArrow()
    place, held = table.column("place").to_numpy(), table.column("held").to_numpy()
    out = np.zeros(PLACES, np.int64)
    out[place[place >= 0]] = held[place >= 0]
    return out, int(held[place < 0].sum())


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # places + bias, languages
    temperature: float

    def scorer(self, spark):
        shared = spark.sparkContext.broadcast((self.languages, self.idf, self.weights.astype(np.float64), self.temperature))

        def score(column: pa.Array) -> pa.Array:
            languages, idf, w, temperature = shared.value
            names, scores = [], []
            for counts in gram_counts(column):
                if counts is None or not languages:
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                at, value = _vector(counts, idf)
                margin = (value @ w[at] + w[-1]) / temperature
                p = np.exp(margin - margin.max())
                best = int(p.argmax())
                names.append(languages[best]), scores.append(float(p[best] / p.sum()))
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

        return score


def _temperature(rows: DataFrame, w: np.ndarray) -> float:
    """The temperature of least log loss on the calibration rows."""
    shared = rows.sparkSession.sparkContext.broadcast(w.astype(np.float64))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        loss = np.zeros(len(TEMPERATURES))
        for index, value, target in zip(part["index"], part["value"], part["target"]):
            margin = value @ shared.value[index] + shared.value[-1]
            for k, t in enumerate(TEMPERATURES):
                scaled = margin / t
                top = scaled.max()
                loss[k] += top + np.log(np.exp(scaled - top).sum()) - scaled[target]
        return pd.DataFrame({"k": np.arange(len(loss)), "loss": loss})

    losses = rows.groupBy("shard").applyInPandas(run, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss"))
    best = losses.orderBy("loss", "k").first()
    return TEMPERATURES[best["k"]] if best else 1.0


def fit_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE, rates: ftrl.Rates = RATES,
) -> LanguageModel:
    """Learn from the rows of ``docs`` with a language; give only rows one may learn from.

    Rows without id or language are left out. Languages are the distinct values, so they
    should be few. Without rows the model predicts ``und``.
    """
    prepare(docs.sparkSession)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    held, n = document_frequencies(usable.select(text_col))
    idf = np.log((1 + n) / (1 + held)) + 1
    if not languages:
        return LanguageModel([], idf, np.zeros((PLACES + 1, 0), np.float32), 1.0)
    draw = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)).cast("long")
    share = F.coalesce(*[F.when(F.col(lang_col) == name, F.lit(int(1_000_000 * per_language / counts[name]) + 1)) for name in languages])
    target = F.coalesce(*[F.when(F.col(lang_col) == name, F.lit(k)) for k, name in enumerate(languages)])
    chosen = usable.where(draw < share).groupBy(id_col).agg(F.min(target).alias("target"))
    shared_idf = docs.sparkSession.sparkContext.broadcast(idf)

    def featurise(column):
        for counted in gram_counts(column):
            yield _vector(counted, shared_idf.value) if counted is not None else ([], [])

    rows = feature_rows(sample_texts(usable, chosen, id_col, text_col), featurise)
    held_back = F.pmod(F.col("rank"), F.lit(CALIBRATION_PART)) == 0
    w = ftrl.fit(rows.where(~held_back), PLACES, len(languages), rates)
    return LanguageModel(languages, idf, w, _temperature(rows.where(held_back), w))


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct (lang_pred, score); ``und`` and 0 if a text is null or has no letter."""
    prepare(docs.sparkSession)
    return scored(docs, model.scorer(docs.sparkSession), [text_col], name, "struct<lang_pred:string,score:double>")

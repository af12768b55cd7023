"""Rounds of training on shards of a bounded sample, and scores for every text.

Each round is one Spark job: every shard of the sample learns from the shared parameters,
Spark averages what the shards changed, and the driver holds only the parameters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.session import materialise

#: Shards follow from the labelled rows, so a model does not depend on the cluster. A shard of
#: fewer rows would learn rare features by heart, as no other shard tempers its change.
SHARDS = 8
SHARD_ROWS = 500


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def bounded_sample(labelled: DataFrame, id_col: str, limit: int) -> DataFrame:
    """About ``limit`` labelled rows at most, by a hash of the id: a fixed, unbiased choice.

    ``shards`` says over how many shards they are dealt.
    """
    count = labelled.count()
    labelled = labelled.withColumn("shards", F.lit(min(SHARDS, max(1, min(count, limit) // SHARD_ROWS))))
    if count <= limit:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * limit / count))


def sample_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, target, shard, rank) of a bounded sample of (id, target); its ids are broadcast."""
    shards = F.col("shards") if "shards" in sample.columns else F.lit(SHARDS)
    chosen = sample.select(F.col(id_col).alias("sample_id"), "target", shards.alias("shards"))
    joined = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "sample_id")
    rank = F.xxhash64(F.col("sample_id"), F.lit("rank"))
    return joined.select("text", "target", F.pmod(rank, F.col("shards")).cast("int").alias("shard"), rank.alias("rank"))


def feature_rows(texts: DataFrame, featurise: Callable, extra: tuple[str, ...] = ()) -> DataFrame:
    """Checkpointed (index, value, target, shard, rank); ``featurise`` maps a column to (indices, values) pairs."""
    def run(batches):
        for batch in batches:
            inputs = [batch.column(batch.schema.get_field_index(c)) for c in ("text", *extra)]
            index, value = [], []
            for i, v in featurise(*inputs):
                index.append(np.asarray(i, np.int32)), value.append(np.asarray(v, np.float32))
            ends = pa.array(np.concatenate(([0], np.cumsum([len(i) for i in index]))).astype(np.int32))
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(ends, flat(index, np.int32)), pa.ListArray.from_arrays(ends, flat(value, np.float32)),
                    *[batch.column(batch.schema.get_field_index(c)) for c in ("target", "shard", "rank")],
                ],
                ["index", "value", "target", "shard", "rank"],
            )
    return materialise(texts.mapInArrow(run, "index array<int>, value array<float>, target int, shard int, rank long"))


def train_rounds(rows: DataFrame, state: np.ndarray, step: Callable, rounds: int) -> np.ndarray:
    """The parameters after ``rounds`` rounds; ``step(state, indices, values, targets)`` learns in place.

    A parameter's change is the mean over the shards that changed it.
    """
    context, width = rows.sparkSession.sparkContext, state.shape[1]
    names = [f"d{k}" for k in range(width)]
    schema = "place long, " + ", ".join(f"{n} double" for n in names)

    def learns(shared):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("rank", kind="stable")
            local = shared.value.copy()
            step(local, part["index"].tolist(), part["value"].tolist(), part["target"].to_numpy())
            delta = local - shared.value
            changed = np.flatnonzero(delta.any(axis=1))
            return pd.DataFrame({"place": changed, **{n: delta[changed, k] for k, n in enumerate(names)}})
        return run

    for _ in range(rounds):
        shared = context.broadcast(state)
        mean = rows.groupBy("shard").applyInPandas(learns(shared), schema).groupBy("place").agg(*[F.avg(n).alias(n) for n in names])
        table = mean.toArrow()  # at most one row per parameter
        state = state.copy()
        places = table.column("place").to_numpy()
        for k, n in enumerate(names):
            state[places, k] += table.column(n).to_numpy()
        shared.unpersist()
    return state


def scored(docs: DataFrame, score: Callable, inputs: list[str], name: str, kind: str) -> DataFrame:
    """``docs`` with one more column; ``score`` maps Arrow columns to an Arrow array.

    ``name`` must not be a column of ``docs``.
    """
    places = [docs.columns.index(c) for c in inputs]

    def run(batches):
        for batch in batches:
            found = score(*[batch.column(p) for p in places])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    more = T.StructField(name, T.DataType.fromDDL(f"x {kind}")["x"].dataType)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, more]))

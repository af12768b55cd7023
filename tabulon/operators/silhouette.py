"""The Euclidean silhouette of a labelling, against a bounded set of reference rows.

Unlike the squared one it does not follow from sums per cluster: every row's mean distance
to each cluster is needed. A random part of each cluster stands for it, so the work grows
with the rows times a bound; the score comes with a standard error, and is exact when the
clusters are small enough to be taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import ship_package, spread, stored

#: Reference rows of all clusters together; the driver holds them and sends them to the tasks.
REFERENCES = 4_000
#: The reference rows of a cluster are dealt to this many groups, which are left out in turn.
GROUPS = 10
_BLOCK = 512
SCHEMA = "silhouette_score double, standard_error double, reference_rows long, exact boolean"


def _scores(points: np.ndarray, cluster: np.ndarray, group: np.ndarray, clusters: int, groups: int):
    """Sums of the silhouettes of a batch: with all references, then without each group."""
    # (cluster, group) of each reference as a column of ones, to add up distances by product
    cell = np.zeros((len(points), clusters * groups))
    cell[np.arange(len(points)), cluster * groups + group] = 1.0
    held = cell.sum(axis=0).reshape(clusters, groups)

    def batches(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            n = batch.num_rows
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, points.shape[1]))
            own, mine, single = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            total = np.zeros(groups + 1)
            for lo in range(0, n, _BLOCK):
                part = slice(lo, lo + _BLOCK)
                d = np.zeros((len(rows[part]), len(points)))
                for k in range(points.shape[1]):  # differences keep the distance to an equal row at 0
                    d += (rows[part, k, None] - points[None, :, k]) ** 2
                sums = (np.sqrt(d) @ cell).reshape(-1, clusters, groups)
                counts = np.broadcast_to(held, sums.shape).copy()
                at = np.arange(len(sums))
                inside = mine[part] >= 0  # a reference is no neighbour of its own
                counts[at[inside], own[part][inside], mine[part][inside]] -= 1
                for left in range(groups + 1):
                    s, c = sums.sum(axis=2), counts.sum(axis=2)
                    if left:
                        s, c = s - sums[:, :, left - 1], c - counts[:, :, left - 1]
                    mean = np.where(c > 0, s / np.maximum(c, 1), np.inf)
                    a = mean[at, own[part]]
                    mean[at, own[part]] = np.inf
                    b = mean.min(axis=1)
                    top = np.maximum(a, b)
                    usable = ~single[part] & np.isfinite(top) & (top > 0)
                    total[left] += np.where(usable, (b - a) / np.where(usable, top, 1.0), 0.0).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["s", "n"])

    return batches


def euclidean_silhouette(
    data: DataFrame, cluster: str = "cluster", features: str = "features", references: int = REFERENCES, seed: int = 42
) -> DataFrame:
    """One row: the score, its standard error, the reference rows and whether the score is exact.

    The silhouette of a row is (b - a) / max(a, b) of its mean distances to its own cluster
    and to the nearest other one; 0 in a cluster of one row. Each cluster is represented by
    about ``references`` / clusters rows, drawn at random, or by all of its rows. The error is a
    jackknife over groups of reference rows, less as more of the rows are references.
    """
    ship_package(data.sparkSession)
    named = data.select(vector_to_array(features).alias("v"), F.col(cluster).alias("c"))
    sizes = {r["c"]: r["n"] for r in named.groupBy("c").agg(F.count(F.lit(1)).alias("n")).limit(references + 1).collect()}
    if len(sizes) < 2:
        raise ValueError("A score needs two clusters or more.")
    if len(sizes) >= sum(sizes.values()):
        raise ValueError("A score needs more observations than clusters.")
    wanted = references // len(sizes)
    if wanted < 2:
        raise ValueError("There are too many clusters for the reference rows; raise references.")
    names = sorted(sizes)
    number = F.coalesce(*[F.when(F.col("c") == F.lit(c), i) for i, c in enumerate(names)])
    share = F.get(F.array(*[F.lit(min(1.0, wanted / sizes[c])) for c in names]), F.col("i"))
    one = F.get(F.array(*[F.lit(sizes[c] == 1) for c in names]), F.col("i"))
    drawn = named.select("v", number.alias("i"), F.rand(seed).alias("u"), F.floor(F.rand(seed + 1) * GROUPS).cast("int").alias("g"))
    # The draw is written, so that a repeated task sees the same references.
    with stored(spread(drawn.select("v", "i", F.when(F.col("u") < share, F.col("g")).otherwise(-1).alias("g"), one.alias("one")))) as held:
        chosen = held.where("g >= 0").select("v", "i", "g").collect()  # about ``references`` rows
        points, of = np.array([r["v"] for r in chosen]), np.array([r["i"] for r in chosen])
        group = np.array([r["g"] for r in chosen])
        made = held.mapInArrow(_scores(points, of, group, len(names), GROUPS), "s array<double>, n long")
        row = made.agg(*[F.sum(F.col("s")[i]) for i in range(GROUPS + 1)], F.sum("n")).first()
    scores, n = [row[i] / row[GROUPS + 1] for i in range(GROUPS + 1)], row[GROUPS + 1]
    exact = len(chosen) == n
    mean = sum(scores[1:]) / GROUPS
    error = math.sqrt((GROUPS - 1) / GROUPS * sum((s - mean) ** 2 for s in scores[1:]) * (1 - len(chosen) / n))
    return data.sparkSession.createDataFrame([(scores[0], 0.0 if exact else error, len(chosen), exact)], SCHEMA)

"""K-Means for several K at once: every pass over the data serves all of them.

A step assigns each row to its nearest centre for every K and adds up the rows of each
(K, cluster) inside the tasks; one aggregation keyed by both gives all new centres. The
number of passes is that of the slowest K, not the sum over K.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.session import ship_package

#: First centres come from about this many rows, a sample of fixed expected size.
SEED_ROWS = 5_000
MAX_STEPS = 300
TOLERANCE = 1e-4
_SUMS = "k int, cluster int, n long, total array<double>, squares double, distances double, distances2 double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (the first of equals) and the squared distance to it."""
    best, number = np.full(len(rows), np.inf), np.zeros(len(rows), dtype=np.int32)
    for i, center in enumerate(centers):  # differences, not norms: equal distances stay equal
        d2 = ((rows - center) ** 2).sum(axis=1)
        closer = d2 < best
        best[closer], number[closer] = d2[closer], i
    return number, best


def _sums(centers: dict[int, np.ndarray]):
    """Per K and cluster of a batch: rows, vector sum, sum of squared norms and distances."""
    def batches(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held:
            rows, out = _matrix(batch.column(0)), []
            norms = (rows**2).sum(axis=1)
            for k, c in centers.items():
                number, d2 = nearest(rows, c)
                for i in np.unique(number):
                    mine = number == i
                    out.append((k, int(i), int(mine.sum()), rows[mine].sum(axis=0), norms[mine].sum(), np.sqrt(d2[mine]).sum(), d2[mine].sum()))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64()]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            names = ["k", "cluster", "n", "total", "squares", "distances", "distances2"]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)], names=names)

    return batches


def sums_by_cluster(vectors: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, dict[int, tuple]]:
    """{K: {cluster: (rows, mean, sum of squared norms, sum of distances, of squared ones)}} by one pass.

    ``vectors`` has one array<double> column ``v``.
    """
    ship_package(vectors.sparkSession)
    width = next(iter(centers.values())).shape[1]
    partial = vectors.select("v").mapInArrow(_sums(centers), _SUMS)
    total = [F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(width)]
    found: dict[int, dict[int, tuple]] = {k: {} for k in centers}
    per_cluster = partial.groupBy("k", "cluster").agg(
        F.sum("n").alias("n"), F.array(*total).alias("total"), F.sum("squares").alias("q"), F.sum("distances").alias("d"),
        F.sum("distances2").alias("d2"),
    )
    for r in per_cluster.collect():  # one row per K and cluster
        found[r["k"]][r["cluster"]] = (r["n"], np.array(r["total"]) / r["n"], r["q"], r["d"], r["d2"])
    return found


def seeds(vectors: DataFrame, rows: int, largest: int, seed: int) -> np.ndarray:
    """``largest`` first centres in the order of k-means++; the first K of them serve K.

    They come from a sample of about SEED_ROWS rows, all rows of a smaller table.
    """
    held = vectors if rows <= SEED_ROWS else vectors.sample(False, SEED_ROWS / rows, seed)
    found = np.array([r["v"] for r in held.select("v").limit(2 * SEED_ROWS).collect()])
    found = found[np.lexsort(found.T[::-1])]  # the draw does not depend on the order of rows
    draw = np.random.default_rng(seed)
    chosen = [found[draw.integers(len(found))]]
    apart = ((found - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < largest:
        total = apart.sum()
        # The best of a few draws, as greedy k-means++ does; only equal rows are left if all are 0.
        tries = draw.choice(len(found), size=2 + int(np.log(largest)), p=apart / total) if total > 0 else [draw.integers(len(found))]
        gains = [np.minimum(apart, ((found - found[i]) ** 2).sum(axis=1)) for i in tries]
        best = min(range(len(tries)), key=lambda t: gains[t].sum())
        chosen.append(found[tries[best]])
        apart = gains[best]
    return np.array(chosen)


def fit_all(vectors: DataFrame, rows: int, ks: Sequence[int], seed: int = 42) -> tuple[dict[int, np.ndarray], int]:
    """Centres for every K, and the number of passes over the data.

    A K stops when none of its centres moves by more than TOLERANCE, or after MAX_STEPS; a
    cluster that loses all rows keeps its centre.
    """
    first = seeds(vectors, rows, max(ks), seed)
    centers, moving, steps = {k: first[:k].copy() for k in ks}, set(ks), 0
    while moving and steps < MAX_STEPS:
        found = sums_by_cluster(vectors, {k: centers[k] for k in sorted(moving)})
        steps += 1
        for k in sorted(moving):
            now = centers[k].copy()
            for i, (_, mean, *_) in found[k].items():
                now[i] = mean
            if ((now - centers[k]) ** 2).sum(axis=1).max() <= TOLERANCE**2:
                moving.discard(k)
            centers[k] = now
    return centers, steps


def assigned(vector: Column, centers: np.ndarray) -> Column:
    """The number of the nearest centre as an expression over an array column."""
    distances = [
        F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
        for c in centers
    ]
    return F.transform(F.array(F.array(*distances)), lambda d: F.array_position(d, F.array_min(d)) - 1)[0].cast("int")


def _silhouettes(centers: dict[int, np.ndarray], sums: dict[int, dict[int, tuple]]):
    """Sum of the squared-Euclidean silhouettes of a batch per K, from each cluster's sums."""
    def batches(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held:
            rows = _matrix(batch.column(0))
            norms, out = (rows**2).sum(axis=1), []
            for k, c in centers.items():
                known = sorted(sums[k])
                n = np.array([sums[k][i][0] for i in known], dtype=float)
                means = np.array([sums[k][i][1] for i in known])
                squares = np.array([sums[k][i][2] for i in known]) / n
                number, _ = nearest(rows, c)
                own = np.searchsorted(known, number)
                # mean squared distance of each row to the members of each cluster
                to = np.maximum(norms[:, None] + squares - 2 * rows @ means.T, 0.0)
                at = np.arange(len(rows))
                size = n[own]
                a = to[at, own] * size / np.maximum(size - 1, 1)
                to[at, own] = np.inf
                b = to.min(axis=1) if len(known) > 1 else np.zeros(len(rows))
                top = np.maximum(a, b)
                s = np.where((size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
                out.append((k, float(s.sum()), len(rows)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], names=["k", "s", "n"]
            )

    return batches


def indices(vectors: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, tuple[int, float, float, float, float]]:
    """{K: (clusters with rows, silhouette, Calinski-Harabasz, Davies-Bouldin, inertia)} by two passes.

    The figures belong to the clusters of the given centres; the means of their rows are
    the centres of the indices, as for any labelling.
    """
    sums = sums_by_cluster(vectors, centers)
    # Distances to the means: the second pass of the sums, with each cluster's own mean as its centre.
    spread = _spreads(vectors, centers, sums)
    made = vectors.select("v").mapInArrow(_silhouettes(centers, sums), "k int, s double, n long")
    score = {r["k"]: r["s"] / r["n"] for r in made.groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    out = {}
    for k in centers:
        known = sorted(sums[k])
        n, means = np.array([sums[k][i][0] for i in known], dtype=float), np.array([sums[k][i][1] for i in known])
        overall, total, clusters = (n[:, None] * means).sum(axis=0) / n.sum(), n.sum(), len(known)
        within = sum(spread[k][i][1] for i in known)
        between = float((n * ((means - overall) ** 2).sum(axis=1)).sum())
        calinski = 1.0 if within == 0 else between * (total - clusters) / (within * (clusters - 1.0))
        mean_distance = np.array([spread[k][i][0] for i in known]) / n
        worst = []
        for i in range(clusters):
            apart = np.sqrt(((means - means[i]) ** 2).sum(axis=1))
            apart[apart == 0] = np.inf
            worst.append(np.delete((mean_distance + mean_distance[i]) / apart, i).max())
        out[k] = (clusters, score[k], float(calinski), float(np.mean(worst)), float(within))
    return out


def _spreads(vectors: DataFrame, centers: dict[int, np.ndarray], sums: dict) -> dict[int, dict[int, tuple[float, float]]]:
    """{K: {cluster: (sum of distances to the mean, of squared ones)}}."""
    def batches(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held:
            rows, out = _matrix(batch.column(0)), []
            for k, c in centers.items():
                number, _ = nearest(rows, c)
                for i in np.unique(number):
                    d2 = ((rows[number == i] - sums[k][int(i)][1]) ** 2).sum(axis=1)
                    out.append((k, int(i), np.sqrt(d2).sum(), d2.sum()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)], names=["k", "cluster", "d", "d2"])

    made = vectors.select("v").mapInArrow(batches, "k int, cluster int, d double, d2 double").groupBy("k", "cluster")
    found: dict[int, dict[int, tuple[float, float]]] = {k: {} for k in centers}
    for r in made.agg(F.sum("d").alias("d"), F.sum("d2").alias("d2")).collect():
        found[r["k"]][r["cluster"]] = (r["d"], r["d2"])
    return found

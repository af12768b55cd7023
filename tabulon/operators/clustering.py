"""K-Means with a search over K and cluster quality indices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators import lloyd
from tabulon.operators.silhouette import euclidean_silhouette
from tabulon.session import materialise, persisted, spread

INDEX_SCHEMA = (
    "k int, silhouette_score double, silhouette_kind string, calinski_harabasz_score double, "
    "davies_bouldin_score double, inertia double"
)


def cluster_indices(
    data: DataFrame, cluster: str = "cluster", features: str = "features", silhouette: str = "squared_euclidean"
) -> DataFrame:
    """Silhouette, Calinski-Harabasz, Davies-Bouldin and inertia of a labelling. One row.

    The ``squared_euclidean`` silhouette follows from the sums of each cluster, so its cost
    grows with the rows and not with their pairs. The ``euclidean`` one is taken against
    reference rows (see ``silhouette.euclidean_silhouette``, which also gives its error).
    Only one centre per cluster and the reference rows reach the driver.
    """
    if silhouette not in ("squared_euclidean", "euclidean"):
        raise ValueError("The silhouette is squared_euclidean or euclidean.")
    named = data.select(F.col(cluster).alias("c"), F.col(features).alias("features"))
    means = named.groupBy("c").agg(
        F.count("*").alias("n"), vector_to_array(Summarizer.mean(F.col("features"))).alias("m")
    )
    means = materialise(means)
    squared = F.aggregate(
        F.zip_with(vector_to_array("features"), "m", lambda x, m: (x - m) * (x - m)),
        F.lit(0.0), lambda total, x: total + x,
    )
    rows = (
        named.join(means, "c").select("c", "n", "m", squared.alias("d2")).groupBy("c")
        .agg(F.first("n").alias("n"), F.first("m").alias("m"), F.avg(F.sqrt("d2")).alias("spread"), F.sum("d2").alias("w"))
        .collect()
    )
    sizes, spread = np.array([r["n"] for r in rows]), np.array([r["spread"] for r in rows])
    centres = np.array([r["m"] for r in rows])
    k, n, within = len(rows), int(sizes.sum()), sum(r["w"] for r in rows)
    if k < 2:
        raise ValueError("A score needs two clusters or more.")
    if k >= n:
        raise ValueError("A score needs more observations than clusters.")
    overall = (sizes[:, None] * centres).sum(axis=0) / n
    between = float((sizes * ((centres - overall) ** 2).sum(axis=1)).sum())
    calinski = 1.0 if within == 0 else between * (n - k) / (within * (k - 1.0))
    worst = []
    for i in range(k):  # one row of the distances at a time
        apart = np.sqrt(((centres - centres[i]) ** 2).sum(axis=1))
        apart[apart == 0] = np.inf
        worst.append(np.delete((spread + spread[i]) / apart, i).max())
    if silhouette == "euclidean":
        score = euclidean_silhouette(named, "c").first()["silhouette_score"]
    else:
        score = ClusteringEvaluator(featuresCol="features", predictionCol="c").evaluate(
            named.withColumn("c", F.col("c").cast("double"))
        )
    return data.sparkSession.createDataFrame(
        [(k, float(score), silhouette, float(calinski), float(np.mean(worst)), float(within))],
        INDEX_SCHEMA,
    )


@dataclass(frozen=True)
class Centers:
    """Fitted centres: ``transform`` adds the nearest one's number as ``cluster``."""

    centers: np.ndarray
    features: str

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)

    def transform(self, data: DataFrame) -> DataFrame:
        return data.withColumn("cluster", lloyd.assigned(vector_to_array(self.features), self.centers))


@dataclass(frozen=True)
class KMeansResult:
    """``labels``: the input with a ``cluster`` column; ``centers``: (cluster, feature array)."""

    labels: DataFrame
    centers: DataFrame
    metrics: DataFrame
    model: KMeansModel | Centers


def _check_k(n_clusters: int, rows: int) -> None:
    if n_clusters < 2:
        raise ValueError("K-Means needs two clusters or more.")
    if n_clusters >= rows:
        raise ValueError("K-Means needs more observations than clusters.")


def _fit(data, k, seed, features):
    estimator = KMeans(k=k, seed=seed, maxIter=300, featuresCol=features, predictionCol="cluster")
    return estimator.fit(data)


def _result(data, model, features):
    labelled = model.transform(data)
    centers = data.sparkSession.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())],
        "cluster int, center array<double>",
    )
    return KMeansResult(labelled, centers, cluster_indices(labelled, "cluster", features), model)


def run_kmeans(
    data: DataFrame, n_clusters: int, random_state: int = 42, features: str = "features"
) -> KMeansResult:
    """Fit K-Means and score the clusters it finds."""
    _check_k(n_clusters, data.count())
    with persisted(data) as held:
        return _result(data, _fit(held, n_clusters, random_state, features), features)


def evaluate_kmeans(
    data: DataFrame, n_clusters: int, random_state: int = 42, features: str = "features"
) -> DataFrame:
    """The quality indices of K-Means for one K. One row."""
    return run_kmeans(data, n_clusters, random_state, features).metrics


@dataclass(frozen=True)
class BestK:
    """``results``: one row of indices per K; ``fitted``: the clustering of the best one."""

    best_k: int
    best_silhouette_score: float
    results: DataFrame
    fitted: KMeansResult


def find_best_k(
    data: DataFrame, min_k: int = 2, max_k: int = 10, random_state: int = 42, features: str = "features",
) -> BestK:
    """Try every K and keep the one with the highest silhouette, the smallest on ties.

    All K are fitted and scored by the same passes over the vectors, which are kept narrow
    in the cache; the number of passes is that of the K that moves longest.
    """
    if min_k < 2:
        raise ValueError("The search over K starts at two clusters.")
    if max_k < min_k:
        raise ValueError("The search over K ends before it starts.")
    with persisted(spread(data.select(vector_to_array(features).alias("v")))) as vectors:
        rows = vectors.count()
        if rows < 3:
            raise ValueError("The search over K needs three observations.")
        candidates = range(min_k, min(max_k, rows - 1) + 1)
        if not candidates:
            raise ValueError("No K in the range is smaller than the number of observations.")
        centers, _ = lloyd.fit_all(vectors, rows, candidates, random_state)
        found = lloyd.indices(vectors, centers)
    lines = [(k, found[k][1], "squared_euclidean", *found[k][2:]) for k in candidates]
    table = data.sparkSession.createDataFrame(lines, INDEX_SCHEMA)
    best = max(lines, key=lambda line: (line[1], -line[0]))
    spark, model = data.sparkSession, Centers(centers[best[0]], features)
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    fitted = KMeansResult(model.transform(data), listed, spark.createDataFrame([best], INDEX_SCHEMA), model)
    return BestK(best[0], best[1], table, fitted)


def cluster_sizes(labelled: DataFrame, cluster: str = "cluster") -> DataFrame:
    return labelled.groupBy(cluster).agg(F.count("*").alias("size")).orderBy(cluster)

"""Prediction quality per group, and its summary over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSIFICATION = ("f1_macro", "f1_weighted", "balanced_accuracy", "accuracy")
REGRESSION = ("r2", "mae", "rmse")


def classification_metrics(
    df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """Macro and weighted F1, balanced accuracy and accuracy from the confusion counts."""
    cells = (
        df.groupBy(*by, F.col(truth).alias("t"), F.col(prediction).alias("p"))
        .agg(F.count("*").alias("n"))
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("s"), zero.alias("q"), hit.alias("h")),
        F.struct(F.col("p").alias("label"), zero.alias("s"), F.col("n").alias("q"), zero.alias("h")),
    )
    labels = (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("h").alias("h"))
    )
    f1 = 2 * F.col("h") / (F.col("s") + F.col("q"))
    recall = F.when(F.col("s") > 0, F.col("h") / F.col("s"))
    return labels.groupBy(*by).agg(
        F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * F.col("s")) / F.sum("s")).alias("f1_weighted"),
        F.avg(recall).alias("balanced_accuracy"),
        (F.sum("h") / F.sum("s")).alias("accuracy"),
    )


def regression_metrics(
    df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """R2, mean absolute error and root mean squared error."""
    miss = F.col(truth) - F.col(prediction)
    sums = df.groupBy(*by).agg(
        F.avg(miss * miss).alias("mse"),
        F.avg(F.abs(miss)).alias("mae"),
        F.var_pop(truth).alias("variance"),
        F.count("*").alias("n"),
    )
    r2 = (
        F.when(F.col("n") < 2, F.lit(float("nan")))
        .when(F.col("variance") > 0, 1 - F.col("mse") / F.col("variance"))
        .when(F.col("mse") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return sums.select(*by, r2.alias("r2"), "mae", F.sqrt("mse").alias("rmse"))


def summarise_folds(scores: DataFrame, metrics: Sequence[str], ddof: int = 1) -> DataFrame:
    """One row per metric over a table with one row per ``fold``.

    ``ddof`` 1 gives the sample deviation (0 for a single fold), 0 the population one.
    """
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics]
    spread = F.coalesce(F.stddev_samp("score"), F.lit(0.0)) if ddof else F.stddev_pop("score")
    return (
        scores.select("fold", F.inline(F.array(*cells)))
        .groupBy("metric")
        .agg(
            F.avg("score").alias("mean"),
            spread.alias("standard_deviation"),
            F.min("score").alias("minimum"),
            F.max("score").alias("maximum"),
            F.transform(
                F.sort_array(F.collect_list(F.struct("fold", "score"))), lambda s: s["score"]
            ).alias("fold_scores"),
        )
    )

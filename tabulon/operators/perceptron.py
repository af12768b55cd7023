"""Cross-validated feed-forward networks on MLlib, with early stopping.

Classes are predicted by MLlib's multilayer perceptron; without hidden layers that is a
softmax regression. L-BFGS runs a few iterations at a time, each run beginning at the
weights of the last; after each, the losses on training and validation rows are taken, and
the weights of the least validation loss are the ones kept. Numbers are predicted by a
linear regression, whose fit is convex and needs no stopping.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators import folds as fd
from tabulon.operators.features import fit_features
from tabulon.operators.forest import CrossValidation, cross_validate
from tabulon.operators.profile import Profile
from tabulon.operators.supervised import LABEL, ROW_ID, TARGET, Prepared, prepare_supervised_data
from tabulon.session import spread, stored

MAX_ITER = 200
PATIENCE = 15
CHUNK = 10
VALIDATION = 0.15
HISTORY = "iteration int, training_loss double, validation_loss double, best boolean"


@dataclass(frozen=True)
class FittedNetwork:
    """``pipeline`` ends in the MLlib model; ``class_names`` is None for a regression.

    ``history`` lists (iteration, training loss, validation loss or None, best): the mean log
    loss for classes, the objective of each iteration for numbers. ``iterations`` led to the weights kept.
    """

    pipeline: PipelineModel
    feature_names: list[str]
    class_names: list[str] | None
    history: list[tuple[int, float, float | None, bool]]
    iterations: int


def _losses(model, rows: DataFrame) -> tuple[float, float | None]:
    """Mean log loss of the training and of the validation rows, in one pass."""
    chance = F.get(vector_to_array("probability"), F.col(LABEL).cast("int"))
    loss = -F.log(F.greatest(chance, F.lit(1e-300)))
    return tuple(
        model.transform(rows).agg(F.avg(F.when(~F.col("_valid"), loss)), F.avg(F.when(F.col("_valid"), loss))).first()
    )


def _fit_classes(
    made: DataFrame, layers: list[int], max_iter: int, patience: int, min_delta: float, seed: int
) -> tuple[MultilayerPerceptronClassificationModel, list[tuple[int, float, float | None, bool]], int]:
    """L-BFGS in runs of CHUNK iterations until the validation loss stops falling.

    Without validation rows all iterations are made, and the last weights are kept.
    """
    training = made.where(~F.col("_valid"))
    best, kept, waited, done, weights, history = math.inf, None, 0, 0, None, []
    while done < max_iter:
        steps = min(CHUNK, max_iter - done)
        estimator = MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=steps, featuresCol="features", labelCol=LABEL)
        if weights is not None:
            estimator.setInitialWeights(weights)
        model = estimator.fit(training.select("features", LABEL))
        weights, done = model.weights, done + steps
        trained, validated = _losses(model, made)
        history.append((done, trained, validated))
        watched = trained if validated is None else validated
        if watched < best - min_delta or kept is None or validated is None:
            best, kept, waited = watched, (model, done), 0
        else:
            waited += steps
            if waited >= patience:
                break
    model, iterations = kept
    return model, [(*line, line[0] == iterations) for line in history], iterations


def fit_network(
    prepared: Prepared, hidden: Sequence[int] = (), max_iter: int = MAX_ITER, random_state: int = 42,
    train: DataFrame | None = None, valid=None, patience: int = PATIENCE, min_delta: float = 0.0,
) -> FittedNetwork:
    """Standardise and encode the features, then fit; on ``train`` if given, else on all rows.

    ``valid`` is a column that marks validation rows: neither preprocessing nor weights learn
    from them, they decide when to stop.
    """
    if any(size < 1 for size in hidden):
        raise ValueError("A hidden layer needs at least one unit.")
    if prepared.task_type == "regression" and hidden:
        raise ValueError("Networks with hidden layers predict classes only.")
    rows, selection = prepared.data if train is None else train, prepared.selection
    marked = rows.withColumn("_valid", F.lit(False) if valid is None else valid)
    fitted = fit_features(marked.where(~F.col("_valid")), selection.numeric_columns, selection.categorical_columns, "standard")
    made = fitted.model.transform(marked).select("features", LABEL, "_valid")
    if prepared.task_type == "regression":
        model = LinearRegression(featuresCol="features", labelCol=LABEL, maxIter=max_iter).fit(made.where(~F.col("_valid")))
        objective = [float(v) for v in model.summary.objectiveHistory]
        history = [(i, v, None, i == len(objective) - 1) for i, v in enumerate(objective)]
        return FittedNetwork(PipelineModel([fitted.model, model]), fitted.feature_names, None, history, max(len(objective) - 1, 0))
    # Values that are new to these rows have no slot, so the width is that of the names.
    layers = [len(fitted.feature_names), *hidden, prepared.number_of_classes]
    with stored(spread(made)) as held:
        model, history, iterations = _fit_classes(held, layers, max_iter, patience, min_delta, random_state)
    return FittedNetwork(PipelineModel([fitted.model, model]), fitted.feature_names, prepared.class_names, history, iterations)


@dataclass(frozen=True)
class NetworkValidation:
    """``validation``: scores and predictions; ``history``: one line per fold and run of
    iterations; ``median_iterations``: the median over folds of the best iteration, cut to
    a whole number, at least 1."""

    validation: CrossValidation
    history: DataFrame
    median_iterations: int


def validate_network(
    prepared: Prepared, hidden: Sequence[int] = (), requested_folds: int = 10, max_iter: int = MAX_ITER,
    random_state: int = 42, patience: int = PATIENCE, validation_fraction: float = VALIDATION, min_delta: float = 0.0,
) -> NetworkValidation:
    """Fit on all folds but one, stopped by a part of them, and score on the one left out."""
    fitted: dict[int, FittedNetwork] = {}
    known: dict[str, int] = {}

    def fit(train, fold):
        valid = fd.validation_share(fold, known["folds"], validation_fraction) if prepared.task_type == "classification" else None
        fitted[fold] = fit_network(prepared, hidden, max_iter, random_state + fold, train, valid, patience, min_delta)
        return fitted[fold].pipeline

    result = cross_validate(
        prepared, fit, requested_folds, random_state, begin=lambda table, folds: known.update(folds=folds), positions=True
    )
    lines = [(fold, *line) for fold in sorted(fitted) for line in fitted[fold].history]
    history = prepared.data.sparkSession.createDataFrame(lines, f"fold int, {HISTORY}")
    return NetworkValidation(result, history, max(1, int(np.median([f.iterations for f in fitted.values()]))))


def cross_validate_network(
    prepared: Prepared, hidden: Sequence[int] = (), requested_folds: int = 10, max_iter: int = MAX_ITER,
    random_state: int = 42,
) -> CrossValidation:
    """The scores and predictions of ``validate_network``."""
    return validate_network(prepared, hidden, requested_folds, max_iter, random_state).validation


def fit_stopped_network(
    prepared: Prepared, hidden: Sequence[int] = (), max_iter: int = MAX_ITER, random_state: int = 42,
    patience: int = PATIENCE, validation_fraction: float = VALIDATION, min_delta: float = 0.0,
) -> FittedNetwork:
    """Fit once on all rows but a validation part, which decides when to stop."""
    if prepared.task_type == "regression":
        return fit_network(prepared, hidden, max_iter, random_state)
    table, count, _ = fd.assign_folds(prepared.data, prepared.task_type, ROW_ID, TARGET, 2, random_state, positions=True)
    with stored(table) as held:
        valid = fd.validation_share(None, count, validation_fraction)
        return fit_network(prepared, hidden, max_iter, random_state, held, valid, patience, min_delta)


def network_history(network: FittedNetwork, spark) -> DataFrame:
    """(iteration, training_loss, validation_loss, best) of a fitted network."""
    return spark.createDataFrame(network.history, HISTORY)


@dataclass(frozen=True)
class NetworkResult:
    """``largest_weights`` is empty for a network with hidden layers; ``layers`` sums up every layer."""

    prepared: Prepared
    validation: NetworkValidation
    selection_metric: str
    primary_score: float
    final: FittedNetwork
    largest_weights: DataFrame
    layers: DataFrame


def train_network(
    df: DataFrame, profile: Profile, target_column: str, feature_columns: Sequence[str] | None = None,
    task_type: str | None = None, hidden: Sequence[int] = (), cv_folds: int = 10, max_iter: int = MAX_ITER,
    patience: int = PATIENCE, min_delta: float = 0.0, validation_fraction: float = VALIDATION, random_state: int = 42,
    key: str | None = None, exclude_columns: Sequence[str] | None = None,
) -> NetworkResult:
    """Detect the task, cross-validate with early stopping, and refit on all rows.

    The final network takes as many iterations as the folds did in the median.
    """
    prepared = prepare_supervised_data(df, profile, target_column, feature_columns, task_type, key, exclude_columns)
    validation = validate_network(prepared, hidden, cv_folds, max_iter, random_state, patience, validation_fraction, min_delta)
    metric = "f1_macro" if prepared.task_type == "classification" else "r2"
    primary = validation.validation.metrics.where(F.col("metric") == metric).first()["mean"]
    iterations = validation.median_iterations if prepared.task_type == "classification" else max_iter
    final = fit_network(prepared, hidden, iterations, random_state)
    spark = df.sparkSession
    largest = largest_weights(final, spark) if not hidden else spark.createDataFrame([], WEIGHTS + ", rank int")
    return NetworkResult(prepared, validation, metric, primary, final, largest, layer_summary(final, spark))


def predict_network(network: FittedNetwork, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction`` and, for classes, ``probabilities`` in the order of the names."""
    if network.class_names is None:
        return network.pipeline.transform(df).select(*df.columns, "prediction")
    scored = network.pipeline.transform(df)
    names = F.array(*[F.lit(n) for n in network.class_names])
    return scored.select(
        *df.columns, F.get(names, F.col("prediction").cast("int")).alias("prediction"),
        vector_to_array("probability").alias("probabilities"),
    )


WEIGHTS = "feature string, output string, weight double"


def _layers(network: FittedNetwork) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights as inputs x outputs, biases) per layer."""
    model = network.pipeline.stages[-1]
    if hasattr(model, "coefficients"):
        return [(model.coefficients.toArray()[:, None], np.array([model.intercept]))]
    flat, sizes, at, out = model.weights.toArray(), model.getLayers(), 0, []
    for inputs, outputs in zip(sizes, sizes[1:], strict=False):
        table = flat[at : at + inputs * outputs].reshape(inputs, outputs)  # an input's weights stand together
        at += inputs * outputs
        out.append((table, flat[at : at + outputs]))
        at += outputs
    return out


def network_weights(network: FittedNetwork, spark) -> DataFrame:
    """(feature, output, weight) of a network without hidden layers."""
    layers = _layers(network)
    if len(layers) > 1:
        raise ValueError("Only a network without hidden layers has direct weights.")
    table, outputs = layers[0][0], network.class_names or ["value"]
    rows = [(f, c, float(table[i, k])) for k, c in enumerate(outputs) for i, f in enumerate(network.feature_names)]
    return spark.createDataFrame(rows, WEIGHTS)


def largest_weights(network: FittedNetwork, spark, top_n: int | None = None) -> DataFrame:
    """The direct weights that matter most per output, by size: 15 of a number, 10 of a class."""
    top_n = top_n or (15 if network.class_names is None else 10)
    order = Window.partitionBy("output").orderBy(F.abs("weight").desc(), "feature")
    return network_weights(network, spark).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def layer_summary(network: FittedNetwork, spark) -> DataFrame:
    """(layer, inputs, outputs, mean and largest size of its weights) of any network."""
    rows = [
        (k, *table.shape, float(np.abs(table).mean()), float(np.abs(table).max())) for k, (table, _) in enumerate(_layers(network))
    ]
    return spark.createDataFrame(rows, "layer int, inputs int, outputs int, mean_absolute double, largest_absolute double")

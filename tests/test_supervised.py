import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import features, fold_features, folds, forest, metrics, perceptron, profile, supervised, trees
from tabulon.plans import catalogue


def people(n=120):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        age = int(rng.integers(20, 65))
        income = None if i % 15 == 0 else float(rng.normal(3000, 600))
        department = None if i % 20 == 0 else ["IT", "HR", "Sales"][i % 3]
        salary = 1000.0 + 40 * age + (500 if department == "IT" else 0) + float(rng.normal(0, 20))
        rows.append((age, income, department, i % 2 == 0, "yes" if age > 42 else "no", salary))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        people(), "age int, income double, department string, active boolean, churn string, salary double"
    ).persist()


@pytest.fixture(scope="module")
def known(table):
    return profile.profile_dataset(table)


# --- choosing the task and the features -------------------------------------------------


def test_task_detection(spark, table):
    assert supervised.detect_task_type(table, "churn").task_type == "classification"
    assert supervised.detect_task_type(table, "active").warning is None
    assert supervised.detect_task_type(table, "salary").task_type == "regression"
    few = supervised.detect_task_type(table.withColumn("k", F.col("age") % 3), "k")
    assert few.task_type == "classification" and few.warning
    with pytest.raises(ValueError, match="does not exist"):
        supervised.detect_task_type(table, "nope")
    with pytest.raises(ValueError, match="two distinct"):
        supervised.detect_task_type(table.withColumn("c", F.lit(1)), "c")
    with pytest.raises(ValueError, match="only missing"):
        supervised.detect_task_type(table.withColumn("c", F.lit(None).cast("int")), "c")


def test_feature_selection(table, known):
    chosen = supervised.select_feature_columns(table, known, "churn")
    assert chosen.feature_columns == ["age", "income", "salary", "department", "active"]
    picked = supervised.select_feature_columns(table, known, "churn", ["active", "age", "age", "churn"])
    assert picked.feature_columns == ["age", "active"]
    left = supervised.select_feature_columns(table, known, "churn", exclude_columns=["salary", "age"])
    assert left.feature_columns == ["income", "department", "active"]
    with pytest.raises(ValueError, match="do not exist"):
        supervised.select_feature_columns(table, known, "churn", ["nope"])
    with pytest.raises(ValueError, match="No supported"):
        supervised.select_feature_columns(table, known, "churn", ["churn"])


def test_missing_targets_are_dropped(table, known):
    gappy = table.withColumn("churn", F.when(F.col("age") > 22, F.col("churn")))
    prepared = supervised.prepare_supervised_data(gappy, known, "churn", ["age"])
    removed = table.where("age <= 22").count()
    assert prepared.removed_target_rows == removed and prepared.rows_used == 120 - removed
    assert prepared.class_names == ["no", "yes"]


def test_text_target_is_no_regression(table, known):
    with pytest.raises(ValueError, match="numeric target"):
        supervised.prepare_supervised_data(table, known, "churn", task_type="regression")
    with pytest.raises(ValueError, match="task_type"):
        supervised.prepare_supervised_data(table, known, "churn", task_type="ranking")


# --- folds and metrics --------------------------------------------------------------------


def labelled(spark, sizes):
    rows = [(i, label) for i, label in enumerate(l for l, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "id long, label string")


def test_stratified_folds(spark):
    df, k, warning = folds.assign_folds(labelled(spark, {"a": 50, "b": 23}), "classification", "id", "label", 10)
    assert k == 10 and warning is None
    per_class = df.groupBy("label", "fold").count().collect()
    for label, n in (("a", 50), ("b", 23)):
        sizes = [r["count"] for r in per_class if r["label"] == label]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    sizes = [r["count"] for r in df.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_folds_are_reduced(spark):
    _, k, warning = folds.assign_folds(labelled(spark, {"a": 20, "b": 4}), "classification", "id", "label", 10)
    assert k == 4 and warning
    _, k, warning = folds.assign_folds(labelled(spark, {"a": 5}), "regression", "id", "label", 10)
    assert k == 5 and warning
    with pytest.raises(ValueError):
        folds.assign_folds(labelled(spark, {"a": 5, "b": 1}), "classification", "id", "label", 3)
    with pytest.raises(ValueError):
        folds.assign_folds(labelled(spark, {"a": 2}), "regression", "id", "label", 3)


def test_row_numbers_in_buckets(spark):
    df = labelled(spark, {"a": 300, "b": 70})
    numbered = folds.number_rows(df, "id", 3, 370, ["label"], rows_per_bucket=30)
    for label, n in (("a", 300), ("b", 70)):
        got = sorted(r["_number"] for r in numbered.where(F.col("label") == label).collect())
        assert got == list(range(n))


def test_validation_share(spark):
    df, k, _ = folds.assign_folds(
        labelled(spark, {"a": 61, "b": 20}), "classification", "id", "label", 3, positions=True
    )
    for fold in range(k):
        rows = df.where(F.col("fold") != fold).withColumn("v", folds.validation_share(fold, k, 0.15))
        for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("v").alias("v")).collect():
            assert r["v"] == int(np.ceil(0.15 * r["n"] - 1e-9))
        assert df.where(F.col("fold") == fold).where(folds.validation_share(fold, k, 0.15)).count() == 0
    with pytest.raises(ValueError):
        folds.validation_share(0, 3, 0.5)


def test_class_weights(spark):
    got = {r["label"]: r["weight"] for r in folds.class_weights(labelled(spark, {"a": 30, "b": 10}), "label").collect()}
    assert got == {"a": 40 / 60, "b": 2.0}


def test_classification_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "t int, p int")
    r = metrics.classification_metrics(df, "t", "p").first()
    assert r["accuracy"] == 0.5 and r["balanced_accuracy"] == 0.5
    assert r["f1_macro"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert r["f1_weighted"] == pytest.approx((2 / 3 + 0.5) / 2)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    assert r["r2"] == pytest.approx(1 - 1.25 / 2) and r["mae"] == 0.5
    assert r["rmse"] == pytest.approx(np.sqrt(1.25 / 3))
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first()["r2"] == 1.0


def test_fold_summary(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.7)], "fold int, f1 double")
    r = metrics.summarise_folds(df, ["f1"], 1).first()
    assert r["fold_scores"] == [0.7, 0.5] and r["standard_deviation"] == pytest.approx(np.std([0.5, 0.7], ddof=1))
    assert metrics.summarise_folds(df, ["f1"], 0).first()["standard_deviation"] == pytest.approx(0.1)
    assert metrics.summarise_folds(df.limit(1), ["f1"], 1).first()["standard_deviation"] == 0.0


# --- random forest ------------------------------------------------------------------------


def test_forest_classification(table, known):
    r = forest.train_random_forest(table, known, "churn", ["age", "department", "active"], cv_folds=3, n_estimators=8)
    assert r.task_type == "classification" and r.selection_metric == "f1_macro" and r.actual_cv_folds == 3
    assert r.primary_score > 0.9
    importance = r.feature_importance.collect()
    assert [i["rank"] for i in importance] == list(range(1, len(importance) + 1))
    assert sum(i["importance"] for i in importance) == pytest.approx(1.0)
    assert importance[0]["feature"] == "age"
    held_out = r.cross_validation.predictions
    assert held_out.count() == 120 and held_out.select("row_id").distinct().count() == 120
    assert {m["metric"] for m in r.cross_validation.metrics.collect()} == set(metrics.CLASSIFICATION)
    assert r.fitted_pipeline.transform(table).count() == 120


def test_forest_regression(table, known):
    r = forest.train_random_forest(table, known, "salary", ["age", "department"], cv_folds=3, n_estimators=8)
    assert r.task_type == "regression" and r.selection_metric == "r2" and r.primary_score > 0.8


def test_forest_in_parts(spark, table, known):
    """Written parts vote together: as many trees, importances of one, and predictions as good."""
    for target, scores in (("churn", "accuracy"), ("salary", "r2")):
        prepared = supervised.prepare_supervised_data(table, known, target, ["age", "department", "active"])
        fitted = features.fit_features(prepared.data, prepared.selection.numeric_columns, prepared.selection.categorical_columns)
        rows = fitted.model.transform(prepared.data).withColumn("_weight", F.lit(1.0))
        estimator = forest.build_random_forest(prepared.task_type, n_estimators=7)
        made = forest.fit_sub_forests(rows, estimator, max_leaves=3 * prepared.rows_used)
        assert [trees for _, trees in made._parts] == [3, 3, 1] and all(isinstance(p, str) for p, _ in made._parts)
        assert made.featureImportances.toArray().sum() == pytest.approx(1.0)
        scored = made.transform(rows)
        assert scored.count() == prepared.rows_used and set(scored.columns) >= {*rows.columns, "prediction"}
        score = metrics.classification_metrics if target == "churn" else metrics.regression_metrics
        assert score(scored, supervised.LABEL, "prediction").first()[scores] > 0.9
        if target == "churn":
            total = scored.select(F.aggregate(vector_to_array("rawPrediction"), F.lit(0.0), lambda a, b: a + b).alias("t")).distinct().collect()
            assert [r["t"] for r in total] == [pytest.approx(7.0)] * len(total)
        made.drop()
        drawn = forest.fit_sub_forests(rows, estimator, max_leaves=100, rows_per_tree=50)
        assert [trees for _, trees in drawn._parts] == [2, 2, 2, 1]


def test_features_of_all_folds_at_once(spark):
    rng = random.Random(3)
    rows = [
        (i, rng.choice([None, float(rng.randint(0, 9)), rng.random() * 100]), rng.choice([5, None]), rng.choice(["a", "b", None, "it's"]), i % 4)
        for i in range(90)
    ]
    rows += [(100 + i, None, 7, "only here", 3) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, x double, y int, s string, fold int").withColumn("late", F.when(F.col("fold") == 2, F.col("x")))
    for scaling in ("standard", "robust", "minmax", "none"):
        fitted = fold_features.fit_features_by_fold(df, ["x", "y", "late"], ["s"], 4, scaling)
        for fold, made in enumerate(fitted):
            alone = features.fit_features(df.where(F.col("fold") != fold), ["x", "y", "late"], ["s"], scaling)
            assert (made.feature_names, made.numeric_columns, made.categorical_columns) == (
                alone.feature_names, alone.numeric_columns, alone.categorical_columns
            )
            got, want = (
                {r["id"]: r["features"].toArray() for r in f.model.transform(df).select("id", "features").collect()} for f in (made, alone)
            )
            for key in want:
                assert got[key] == pytest.approx(want[key], rel=1e-9, abs=1e-9)


def test_forest_errors():
    with pytest.raises(ValueError):
        forest.build_random_forest("classification", n_estimators=0)
    with pytest.raises(ValueError):
        forest.build_random_forest("ranking")


# --- network -----------------------------------------------------------------------------


def test_network_classification(spark, table, known):
    prepared = supervised.prepare_supervised_data(table, known, "churn")
    result = perceptron.cross_validate_network(prepared, [6], 3)
    assert result.actual_folds == 3 and result.predictions.count() == prepared.rows_used
    scores = {r["metric"]: r["mean"] for r in result.metrics.collect()}
    assert 0 <= scores["accuracy"] <= 1
    linear = perceptron.fit_network(prepared)
    scored = perceptron.predict_network(linear, table.drop("churn"))
    first = scored.first()
    assert first["prediction"] in prepared.class_names and sum(first["probabilities"]) == pytest.approx(1)
    weights = perceptron.network_weights(linear, spark)
    assert weights.count() == 2 * len(linear.feature_names)
    hidden = perceptron.fit_network(prepared, [4])
    with pytest.raises(ValueError):
        perceptron.network_weights(hidden, spark)


def test_network_regression(spark, table, known):
    prepared = supervised.prepare_supervised_data(table, known, "income")
    assert perceptron.predict_network(perceptron.fit_network(prepared), table).where("prediction is null").count() == 0
    for hidden in ([3], [0]):
        with pytest.raises(ValueError):
            perceptron.fit_network(prepared, hidden)


def test_network_stops_early_and_keeps_the_best(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), *(rng.gauss(0, 1) for _ in range(6))) for i in range(160)]
    noise = [f"n{k}" for k in range(6)]
    df = spark.createDataFrame(
        [(*r, "yes" if r[1] + r[2] + rng.gauss(0, 2) > 0 else "no") for r in rows], ["id", "a", "b", *noise, "y"]
    )
    prepared = supervised.prepare_supervised_data(df, profile.profile_dataset(df), "y", ["a", "b", *noise], key="id")
    network = perceptron.fit_stopped_network(prepared, [12], max_iter=300, patience=20)
    lines = perceptron.network_history(network, spark).orderBy("iteration").collect()
    assert len(lines) >= 3 and lines[-1]["iteration"] < 300  # noise is learnt by heart, so it stops
    least = min(r["validation_loss"] for r in lines)
    assert [r["iteration"] for r in lines if r["best"]] == [network.iterations] and next(r for r in lines if r["best"])["validation_loss"] == least
    assert lines[-1]["training_loss"] <= lines[0]["training_loss"]
    # the kept weights are those of the best line: its loss comes out again from the stored split
    rows = folds.assign_folds(prepared.data, "classification", supervised.ROW_ID, supervised.TARGET, 2, positions=True)[0]
    scored = network.pipeline.transform(rows.where(folds.validation_share(None, 2, 0.15)))
    chance = F.get(vector_to_array("probability"), F.col(supervised.LABEL).cast("int"))
    assert scored.agg(F.avg(-F.log(chance))).first()[0] == pytest.approx(least)


def test_network_in_one_call(spark, table, known):
    r = perceptron.train_network(table, known, "churn", ["age", "department", "active"], cv_folds=3, max_iter=20)
    assert r.selection_metric == "f1_macro" and 0 <= r.primary_score <= 1 and r.validation.validation.actual_folds == 3
    history = r.validation.history.collect()
    assert {h["fold"] for h in history} == {0, 1, 2} and all(h["validation_loss"] > 0 for h in history)
    assert 1 <= r.validation.median_iterations <= 20 and r.final.iterations == r.validation.median_iterations
    top = r.largest_weights.collect()
    assert {t["output"] for t in top} == set(r.prepared.class_names)
    layer = r.layers.first()
    assert (layer["layer"], layer["inputs"], layer["outputs"]) == (0, len(r.final.feature_names), 2)
    # the weights listed are those that predict: probabilities by hand
    (table_, bias), row = perceptron._layers(r.final)[0], r.final.pipeline.transform(r.prepared.data).first()
    z = row["features"].toArray() @ table_ + bias
    assert row["probability"].toArray() == pytest.approx(np.exp(z) / np.exp(z).sum())


def test_network_of_numbers_in_one_call(spark, table, known):
    r = perceptron.train_network(table, known, "salary", ["age", "department"], cv_folds=3)
    assert r.selection_metric == "r2" and r.primary_score > 0.5
    ranks = [t["rank"] for t in r.largest_weights.orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and {t["output"] for t in r.largest_weights.collect()} == {"value"}


def test_forest_with_many_classes(spark):
    rows = [(i, float(i % 120), f"c{i % 120:03d}") for i in range(480)]
    t = spark.createDataFrame(rows, "id long, x double, y string")
    prepared = supervised.prepare_supervised_data(t, profile.profile_dataset(t), "y", ["x"], "classification", "id")
    estimator = forest.build_random_forest("classification", n_estimators=2, max_depth=6, max_bins=128)
    result = forest.cross_validate_random_forest(prepared, estimator, 2)
    assert result.predictions.count() == 480 and prepared.number_of_classes == 120


@pytest.mark.parametrize("name,want", [("forest_held_out", (3,)), ("forest_importance", ())])  # the SQL fixes three folds
def test_registered_forests_have_the_operators_defaults(spark, monkeypatch, name, want):
    class Reached(Exception):
        pass

    def stop(prepared, estimator, *folds, **options):
        raise Reached(estimator.getNumTrees(), estimator.getMaxDepth(), folds, options)

    monkeypatch.setattr(forest, "cross_validate_random_forest", stop)
    monkeypatch.setattr(forest, "fit_final_random_forest", stop)
    with pytest.raises(Reached) as reached:
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert reached.value.args == (300, forest.MAX_DEPTH, want, {})


def test_forests_take_few_jobs(spark, table):
    """A tree is grown by one task, so the jobs do not grow with the depth of the trees."""
    noise = F.pmod(F.xxhash64("age", "salary"), F.lit(97)).cast("double")
    assembled = VectorAssembler(inputCols=["age", "salary"], outputCol="features").transform(table)
    rows = assembled.select("features", noise.alias("noise"), F.monotonically_increasing_id().alias(supervised.ROW_ID))
    for task, label in (("classification", F.col("noise") % 2), ("regression", F.col("noise"))):
        estimator = forest.build_random_forest(task, n_estimators=20, handle_class_imbalance=False)
        try:
            spark.sparkContext.setJobGroup(f"forest {task}", "forest")
            made = forest.fit_sub_forests(rows.withColumn(supervised.LABEL, label), estimator)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest {task}")) < 16
        made.drop()


def best_split(codes, label, weight, classes):
    """(gain, feature, cut) by trying everything."""
    def unlike(rows):
        w = weight[rows].sum()
        if classes:
            return w - sum(weight[rows][label[rows] == c].sum() ** 2 for c in (0, 1)) / w
        mean = (weight[rows] * label[rows]).sum() / w
        return (weight[rows] * (label[rows] - mean) ** 2).sum()

    every, found = np.ones(len(label), bool), (0.0, -1, 0)
    for f in range(codes.shape[1]):
        for cut in range(codes[:, f].max()):
            left = codes[:, f] <= cut
            if left.any() and not left.all():
                gain = unlike(every) - unlike(left) - unlike(~left)
                if gain > found[0] + 1e-9:
                    found = (gain, f, cut)
    return found


@pytest.mark.parametrize("classes", [True, False])
def test_a_tree_equals_brute_force(classes):
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 6, (70, 3)), axis=0).astype(np.uint8)
    label = rng.integers(0, 2, len(codes)).astype(float) if classes else rng.normal(0, 3, len(codes))
    weight = rng.integers(1, 4, len(codes)).astype(float)
    stats = [weight * (label == 0), weight * (label == 1)] if classes else [weight, weight * label, weight * label**2]
    made = trees.grow_tree(codes, stats, classes, 6, 3, 30, rng)
    gains = np.zeros(3)

    def walk(node, rows):
        gain, f, cut = best_split(codes[rows], label[rows], weight[rows], classes)
        if made.feature[node] < 0:  # a leaf, or leaves merged as they say the same
            if classes and gain:
                assert len({float(s) for s in np.argmax(made.scores(codes[rows]), axis=1)}) == 1
            return
        assert (made.feature[node], made.cut[node]) == (f, cut)
        gains[f] += gain
        left = codes[rows][:, f] <= cut
        walk(made.child[node], rows[left])
        walk(made.child[node] + 1, rows[~left])

    walk(0, np.arange(len(codes)))
    assert made.importances == pytest.approx(gains / gains.sum())
    scores = made.scores(codes)
    if classes:
        assert (np.argmax(scores, axis=1) == label).all()
    else:
        assert scores[:, 0] == pytest.approx(label)


def test_cuts_and_bins():
    values = np.array([1.0, 1, 1, 2, 4, 4, 8])
    assert trees.cut_points(values, 1, 8, 32).tolist() == [1.5, 3, 6]
    assert trees.cut_points(np.zeros(5), 0, 1, 32).tolist() == [0.5]  # the sample missed the other value
    assert trees.cut_points(np.zeros(5), 0, 0, 32).tolist() == []
    many = trees.cut_points(np.arange(1000.0), 0, 999, 32)
    assert len(many) == 31 and np.bincount(np.searchsorted(many, np.arange(1000.0))).max() <= 33
    heavy = trees.cut_points(np.concatenate([np.arange(1000.0), np.full(300, 500.0)]), 0, 999, 32)
    assert len(heavy) == 31 and (heavy[heavy > 500][:3] == [500.5, 501.5, 502.5]).all()
    bins = trees.Bins.of([many] * 30 + [np.empty(0)])  # more than a long holds
    rows = np.random.default_rng(2).integers(0, 1000, (50, 31)).astype(float)
    longs = [trees._packed(bins, i, pd.Series(list(rows))).to_numpy() for i in range(bins.longs)]
    assert bins.longs == 3
    want = np.stack([np.searchsorted(c, rows[:, f]) for f, c in enumerate(bins.cuts)], axis=1)
    assert (bins.codes(longs) == want).all()
    cells, number = trees._distinct([np.concatenate([x, x]) for x in longs])
    assert (number[:50] == number[50:]).all() and all((c[number[:50]] == x).all() for c, x in zip(cells, longs))

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import clustering, features, lloyd, silhouette
from tabulon.plans.analyses import kmeans_analysis

ROWS = [
    (20, 1000.0, "IT"), (21, 1100.0, "IT"), (22, None, "HR"), (40, 5000.0, "HR"), (41, 5100.0, None),
    (42, 5200.0, "IT"), (60, 9000.0, "Sales"), (61, 9100.0, "Sales"), (62, 9200.0, "Sales"),
]


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame(ROWS, "age int, income double, department string")
    return df.withColumns({"same": F.lit("x"), "empty": F.lit(None).cast("double")})


def matrix(prepared):
    rows = prepared.data.orderBy("age").select(vector_to_array("features").alias("v")).collect()
    return np.array([r["v"] for r in rows])


@pytest.mark.parametrize("scaling", ["standard", "robust", "minmax", "none", "Standard"])
def test_scaling(people, scaling):
    x = matrix(features.prepare_clustering_data(people, ["age", "income"], [], scaling))
    raw = np.array([[a, 5150.0 if i is None else i] for a, i, _ in ROWS])
    q1, median, q3 = np.quantile(raw, [0.25, 0.5, 0.75], axis=0)
    want = {
        "standard": (raw - raw.mean(axis=0)) / raw.std(axis=0),
        "robust": (raw - median) / (q3 - q1),
        "minmax": (raw - raw.min(axis=0)) / (raw.max(axis=0) - raw.min(axis=0)),
        "none": raw,
    }[scaling.lower()]
    assert x == pytest.approx(want)


def test_encoding_and_removed_columns(people):
    p = features.prepare_clustering_data(people, ["age", "empty"], ["department", "same"])
    assert p.removed_columns == ["empty", "same"]
    assert p.feature_names == ["age", "department_HR", "department_IT", "department_Sales"]
    x = matrix(p)
    assert x.shape == (9, 4) and (x[:, 1:].sum(axis=1) == 1).all()
    assert x[4, 2] == 1  # HR 2, IT 3, Sales 3: the tie goes to the smaller value


def test_unseen_values_become_zeros(spark, people):
    fitted = features.fit_features(people, ["age"], ["department"])
    new = spark.createDataFrame([(30, 1.0, "Law")], "age int, income double, department string")
    row = fitted.model.transform(new).select(vector_to_array("features").alias("v")).first()
    assert row["v"] == [30.0, 0.0, 0.0, 0.0]


def test_pipeline_can_be_saved(spark, people, tmp_path):
    from pyspark.ml import PipelineModel

    fitted = features.fit_features(people, ["age"], ["department"], "standard")
    fitted.model.save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(people)
    assert again.select("features").collect() == fitted.model.transform(people).select("features").collect()


def test_preparation_errors(people):
    for arguments in (([],), (["nope"],), (["empty"], ["same"])):
        with pytest.raises(ValueError):
            features.prepare_clustering_data(people, *arguments)
    with pytest.raises(ValueError, match="Unsupported scaling"):
        features.prepare_clustering_data(people, ["age"], [], "log")


def test_odd_names_and_quotes(spark):
    df = spark.createDataFrame([(1.0, "it's"), (2.0, 'a "b" \\ c')], ["a.b", "c`d e"])
    p = features.prepare_clustering_data(df, ["a.b"], ["c`d e"], "none")
    assert p.feature_names == ["a.b", 'c`d e_a "b" \\ c', "c`d e_it's"]
    rows = p.data.select(vector_to_array("features").alias("v")).collect()
    assert sorted(r["v"] for r in rows) == [[1.0, 0.0, 1.0], [2.0, 1.0, 0.0]]


def test_too_many_categories_is_an_error(spark):
    df = spark.range(50).selectExpr("cast(id as string) as k")
    with pytest.raises(ValueError, match="max_categories"):
        features.fit_features(df, [], ["k"], max_categories=10)


def points(spark, rows):
    df = spark.createDataFrame([(list(map(float, r)),) for r in rows], "x array<double>")
    return df.select(array_to_vector("x").alias("features"))


TWO = [(0, 0), (0, 1), (1, 0), (10, 10), (10, 11), (11, 10)]
THREE = [*[(i % 2, i // 2) for i in range(4)], *[(20 + i % 2, i // 2) for i in range(4)],
         *[(10 + i % 2, 20 + i // 2) for i in range(4)]]


def test_indices_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(60, 3)), rng.integers(0, 4, 60)
    df = spark.createDataFrame(
        [(v.tolist(), int(k)) for v, k in zip(x, c)], "x array<double>, c int"
    ).select("c", array_to_vector("x").alias("features"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def silhouette(d):
        s = []
        for i in range(60):
            a = d[i][(c == c[i]) & (np.arange(60) != i)].mean()
            b = min(d[i][c == k].mean() for k in range(4) if k != c[i])
            s.append((b - a) / max(a, b))
        return np.mean(s)

    means = np.array([x[c == k].mean(axis=0) for k in range(4)])
    w = sum(((x[c == k] - means[k]) ** 2).sum() for k in range(4))
    b = sum((c == k).sum() * ((means[k] - x.mean(axis=0)) ** 2).sum() for k in range(4))
    s = [np.sqrt(((x[c == k] - means[k]) ** 2).sum(axis=1)).mean() for k in range(4)]
    apart = np.sqrt(((means[:, None] - means[None]) ** 2).sum(-1))
    davies = np.mean([max((s[i] + s[j]) / apart[i, j] for j in range(4) if j != i) for i in range(4)])

    r = clustering.cluster_indices(df, "c").first()
    assert r["silhouette_score"] == pytest.approx(silhouette(d**2)) and r["silhouette_kind"] == "squared_euclidean"
    assert r["inertia"] == pytest.approx(w)
    assert r["calinski_harabasz_score"] == pytest.approx((b / 3) / (w / 56))
    assert r["davies_bouldin_score"] == pytest.approx(davies)
    again = clustering.cluster_indices(df.repartition(7), "c").first()
    assert [again[c] for c in again.asDict() if c != "silhouette_kind"] == pytest.approx([r[c] for c in r.asDict() if c != "silhouette_kind"])


def plain_silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        mates = (c == c[i]) & (np.arange(len(x)) != i)
        if not mates.any():
            out.append(0.0)
            continue
        a, b = d[i][mates].mean(), min(d[i][c == k].mean() for k in set(c) if k != c[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


def labelled(spark, x, c):
    rows = [(v.tolist(), int(k)) for v, k in zip(x, c)]
    return spark.createDataFrame(rows, "x array<double>, c int").select("c", array_to_vector("x").alias("features"))


def test_euclidean_silhouette_is_exact_on_few_rows(spark):
    for rows, c in ((TWO, [0, 0, 0, 1, 1, 1]), (THREE, [0] * 4 + [1] * 4 + [2] * 4), (THREE, [0] * 5 + [1] * 6 + [2])):
        x, c = np.array(rows, dtype=float), np.array(c)
        r = silhouette.euclidean_silhouette(labelled(spark, x, c), "c").first()
        assert r["silhouette_score"] == pytest.approx(plain_silhouette(x, c)) and r["exact"] and r["standard_error"] == 0
    assert clustering.cluster_indices(labelled(spark, x, c), "c", silhouette="euclidean").first()["silhouette_kind"] == "euclidean"
    with pytest.raises(ValueError):
        silhouette.euclidean_silhouette(labelled(spark, x, np.zeros(12)), "c")


def test_euclidean_silhouette_by_references(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 1.5, size=(n, 3)) for m, n in ((0, 900), (3, 500), (6, 60))])
    c = np.repeat([7, 8, 9], [900, 500, 60])
    want, inside = plain_silhouette(x, c), 0
    data = labelled(spark, x, c)
    for seed in range(6):
        r = silhouette.euclidean_silhouette(data, "c", references=300, seed=seed).first()
        assert not r["exact"] and 150 < r["reference_rows"] < 450 and 0 < r["standard_error"] < 0.05
        assert r["silhouette_score"] == pytest.approx(want, abs=4 * r["standard_error"])
        inside += abs(r["silhouette_score"] - want) <= 2 * r["standard_error"]
    assert inside >= 4


def test_fused_steps_equal_plain_steps(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(200, 3)), 2)
    vectors = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3)
    first = lloyd.seeds(vectors, 200, 5, 42)
    centers, steps = lloyd.fit_all(vectors, 200, range(2, 6), 42)
    longest = 0
    for k in range(2, 6):
        now, moved = first[:k].copy(), 0
        while True:
            c = ((x[:, None] - now[None]) ** 2).sum(-1).argmin(axis=1)
            then = np.array([x[c == i].mean(axis=0) if (c == i).any() else now[i] for i in range(k)])
            moved += 1
            done = ((then - now) ** 2).sum(axis=1).max() <= lloyd.TOLERANCE**2
            now = then
            if done:
                break
        longest = max(longest, moved)
        assert centers[k] == pytest.approx(now)
    assert steps == longest  # the passes of the slowest K, not of all together
    found = lloyd.indices(vectors, centers)
    for k in range(2, 6):
        c = lloyd.nearest(x, centers[k])[0]
        r = clustering.cluster_indices(labelled(spark, x, c), "c").first()
        want = (r["k"], r["silhouette_score"], r["calinski_harabasz_score"], r["davies_bouldin_score"], r["inertia"])
        assert found[k] == pytest.approx(want)
        marked = vectors.select("v", lloyd.assigned(F.col("v"), centers[k]).alias("c")).collect()
        assert [r["c"] for r in marked] == lloyd.nearest(np.array([r["v"] for r in marked]), centers[k])[0].tolist()


def test_equal_rows_and_lost_clusters(spark):
    data = points(spark, [(1, 1)] * 5 + [(2, 2)])
    best = clustering.find_best_k(data, 2, 4)
    assert best.best_k == 2 and best.fitted.labels.count() == 6


def test_two_blobs(spark):
    result = clustering.run_kmeans(points(spark, TWO), 2)
    assert [r["size"] for r in clustering.cluster_sizes(result.labels).collect()] == [3, 3]
    assert result.centers.count() == 2
    assert result.metrics.first()["silhouette_score"] > 0.9


def test_best_k_on_three_blobs(spark):
    best = clustering.find_best_k(points(spark, THREE), 2, 5)
    assert best.best_k == 3 and [r["k"] for r in best.results.collect()] == [2, 3, 4, 5]
    assert best.fitted.centers.count() == 3


def test_k_errors(spark):
    data = points(spark, TWO)
    for k in (1, 6):
        with pytest.raises(ValueError):
            clustering.run_kmeans(data, k)
    for arguments in ((1, 3), (4, 3)):
        with pytest.raises(ValueError):
            clustering.find_best_k(data, *arguments)
    with pytest.raises(ValueError):
        clustering.find_best_k(points(spark, TWO[:2]))


def test_one_call_analysis(people):
    result = kmeans_analysis(people, ["age", "income"], ["department"], "standard", 2, 3)
    assert sum(r["size"] for r in result.cluster_sizes.collect()) == 9
    assert result.best_k.best_k in (2, 3)

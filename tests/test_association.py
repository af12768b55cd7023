import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.functions import special
from tabulon.operators import association, corrections, pair_ranks, ranks


def average_ranks(values):
    return [
        sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values
    ]


def one(df):
    return df.first().asDict()


@pytest.fixture
def small_buckets(monkeypatch):
    """Cut even small columns into many buckets, as a large table would be."""
    original = ranks.boundaries
    monkeypatch.setattr(
        ranks, "boundaries", lambda df, columns, rows, rows_per_bucket=20: original(df, columns, rows, min(rows_per_bucket, 20))
    )


def test_perfect_correlation(spark):
    df = spark.createDataFrame([(i, i * 1000) for i in range(1, 6)], "experience int, salary int")
    r = one(association.spearman_correlation(df, "experience", "salary"))
    assert r["statistic"] == pytest.approx(1.0) and r["p_value"] < 0.05 and r["n"] == 5


def test_pairwise_deletion(spark):
    rows = [(1.0, 10.0), (2.0, None), (3.0, 30.0), (None, 40.0), (5.0, 50.0)]
    r = one(association.spearman_correlation(spark.createDataFrame(rows, "x double, y double"), "x", "y"))
    assert r["n"] == 3 and r["statistic"] == pytest.approx(1.0)


def test_spearman_errors(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "x int, y int")
    with pytest.raises(ValueError, match="variation"):
        association.spearman_correlation(df, "x", "y")
    with pytest.raises(ValueError, match="At least two"):
        association.spearman_correlation(df.limit(1), "x", "y")
    with pytest.raises(ValueError, match="does not exist"):
        association.spearman_correlation(df, "x", "z")


def test_spearman_against_brute_force_in_buckets(spark, small_buckets):
    rng = random.Random(1)
    rows = [(float(rng.randint(0, 30)), rng.choice([5.0, rng.random()])) for _ in range(300)]
    rx, ry = (average_ranks([r[i] for r in rows]) for i in (0, 1))
    mx = sum(rx) / 300
    xy = sum((a - mx) * (b - mx) for a, b in zip(rx, ry))
    rho = xy / math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - mx) ** 2 for b in ry))
    r = one(association.spearman_correlation(spark.createDataFrame(rows, "x double, y double"), "x", "y"))
    assert r["statistic"] == pytest.approx(rho, rel=1e-12)


def test_mann_whitney(spark):
    rows = [(i, "A") for i in range(1, 6)] + [(i, "B") for i in range(10, 15)]
    r = one(association.mann_whitney_test(spark.createDataFrame(rows, "score int, g string"), "score", "g"))
    assert (r["group_1"], r["group_1_n"], r["group_2_n"], r["statistic"]) == ("A", 5, 5, 0.0)
    assert r["p_value"] == pytest.approx(2 / 252) and r["p_method"] == "exact"
    assert r["rank_biserial"] == -1.0 and r["group_1_median"] == 3.0


def test_mann_whitney_needs_two_groups(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "x int, g string")
    with pytest.raises(ValueError, match="exactly two"):
        association.mann_whitney_test(df, "x", "g")


def test_mann_whitney_brute_force_in_buckets(spark, small_buckets):
    rng = random.Random(2)
    rows = [(float(rng.randint(0, 60)), rng.choice("AAB")) for _ in range(400)]
    a = sorted(x for x, g in rows if g == "A")
    b = sorted(x for x, g in rows if g == "B")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    r = one(association.mann_whitney_test(spark.createDataFrame(rows, "x double, g string"), "x", "g"))
    assert r["statistic"] == u
    middle = lambda v: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert (r["group_1_median"], r["group_2_median"]) == (middle(a), middle(b))


@pytest.mark.parametrize("few", [2, 12])
def test_kruskal_brute_force_in_buckets(spark, small_buckets, monkeypatch, few):
    monkeypatch.setattr(association, "FEW_GROUPS", few)
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 40)), rng.choice("ABCD")) for _ in range(300)]
    values = [x for x, _ in rows]
    rank, n = average_ranks(values), len(rows)
    sums = {g: [r for r, (_, h) in zip(rank, rows) if h == g] for g in "ABCD"}
    ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
    h = 12 / (n * (n + 1)) * sum(sum(r) ** 2 / len(r) for r in sums.values()) - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n)
    result = association.kruskal_wallis_test(spark.createDataFrame(rows, "x double, g string"), "x", "g")
    r = one(result.test)
    assert r["statistic"] == pytest.approx(h, rel=1e-9) and r["number_of_groups"] == 4
    for row in result.groups.collect():
        group = sorted(x for x, g in rows if g == row["group_name"])
        assert row["n"] == len(group)
        assert row["median"] == (group[(len(group) - 1) // 2] + group[len(group) // 2]) / 2


def groups_frame(spark):
    rows = [(b + i, g) for g, b in (("A", 1), ("B", 20), ("C", 40)) for i in range(5)]
    return spark.createDataFrame(rows, "score int, g string")


def test_posthoc_after_significant_kruskal(spark):
    result = association.kruskal_wallis_with_posthoc(groups_frame(spark), "score", "g")
    assert result.global_test.p_value < 0.05
    pairs = result.posthoc.collect()
    assert sorted((r["group_1"], r["group_2"]) for r in pairs) == [("A", "B"), ("A", "C"), ("B", "C")]
    assert all(r["p_value"] == pytest.approx(2 / 252) for r in pairs)
    assert all(r["adjusted_p_value"] == pytest.approx(6 / 252) and r["significant"] for r in pairs)


def test_posthoc_skipped_when_not_significant(spark):
    rows = [(i, g) for g in "ABC" for i in range(10)]
    result = association.kruskal_wallis_with_posthoc(spark.createDataFrame(rows, "x int, g string"), "x", "g")
    assert result.posthoc is None


@pytest.mark.parametrize("few", [0, 12])
def test_posthoc_pairs_are_ranked_apart_in_buckets(spark, small_buckets, monkeypatch, few):
    monkeypatch.setattr(association, "FEW_GROUPS", few)
    rng = random.Random(4)
    rows = [(float(rng.randint(0, 50)), rng.choice("ABC")) for _ in range(200)]
    df = spark.createDataFrame(rows, "x double, g string")
    got = {(r["group_1"], r["group_2"]): r for r in association.mann_whitney_posthoc(df, "x", "g").collect()}
    for a, b in itertools.combinations("ABC", 2):
        pair = one(association.mann_whitney_test(df.where(F.col("g").isin(a, b)), "x", "g"))
        for field in ("statistic", "p_value", "rank_biserial", "group_1_median", "group_2_median"):
            assert got[(a, b)][field] == pytest.approx(pair[field])


def test_pairs_of_many_groups_by_products(spark, small_buckets, monkeypatch):
    """Groups in several blocks, values in several buckets and several products of each."""
    rng = random.Random(8)
    rows = [(rng.choice([float(rng.randint(0, 12)), rng.random(), float("inf")]), f"g{rng.randint(0, 39):02}") for _ in range(900)]
    rows += [(float(i), "tiny") for i in range(3)] + [(float("-inf"), "g00")] * 7
    by_group = {}
    for x, g in rows:
        by_group.setdefault(g, []).append(x)
    expected = {}
    for a, b in itertools.combinations(sorted(by_group), 2):
        u = sum((x > y) + 0.5 * (x == y) for x in by_group[a] for y in by_group[b])
        counts = {}
        for x in by_group[a] + by_group[b]:
            counts[x] = counts.get(x, 0) + 1
        ties = sum(t**3 - t for t in counts.values())
        n1, n2 = len(by_group[a]), len(by_group[b])
        expected[a, b] = (n1, n2, u, *special.mann_whitney_p(u, n1, n2, ties))

    got = association.mann_whitney_posthoc(spark.createDataFrame(rows, "x double, g string").repartition(3), "x", "g", correction="bonferroni")
    found = {(r["group_1"], r["group_2"]): (r["group_1_n"], r["group_2_n"], r["statistic"], r["p_value"], r["p_method"]) for r in got.collect()}
    assert found.keys() == expected.keys()
    for pair, (n1, n2, u, p, method) in expected.items():
        assert found[pair] == (n1, n2, u, pytest.approx(p), method)


def test_product_blocks(monkeypatch):
    """One bucket by itself: blocks of groups and of values change nothing."""
    rng = random.Random(9)
    counts = {(float(rng.randint(0, 40)), rng.randint(0, 10)): rng.randint(1, 5) for _ in range(120)}
    below = [rng.randint(0, 9) for _ in range(11)]

    def figures():
        out = {}
        for block in range(-(-11 // pair_ranks.BLOCK_GROUPS)):
            first = block * pair_ranks.BLOCK_GROUPS
            rows = [(x, i, c) for (x, i), c in counts.items()]
            rows += [(float("nan"), i, below[i]) for i in range(first, min(11, first + pair_ranks.BLOCK_GROUPS))]
            rng.shuffle(rows)
            made = pair_ranks._products((0, block, 11), pd.DataFrame(rows, columns=["x", "i", "c"]))
            for r in made.itertuples():
                u, t = out.get((r.a, r.b), (0, 0))
                out[r.a, r.b] = (u + r.u, t + r.t)
        return out

    expected = {}
    for a, b in itertools.combinations(range(11), 2):
        of = {g: {x: c for (x, i), c in counts.items() if i == g} for g in (a, b)}
        u = sum(c * (below[b] + sum(d for y, d in of[b].items() if y < x) + of[b].get(x, 0) / 2) for x, c in of[a].items())
        expected[a, b] = (u, sum(c * of[b].get(x, 0) * (c + of[b].get(x, 0)) for x, c in of[a].items()))
    assert figures() == expected
    monkeypatch.setattr(pair_ranks, "BLOCK_GROUPS", 4)
    monkeypatch.setattr(pair_ranks, "BLOCK_VALUES", 7)
    assert figures() == expected


def test_group_count_errors(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B")], "x int, g string")
    with pytest.raises(ValueError, match="three groups"):
        association.kruskal_wallis_test(df, "x", "g")
    with pytest.raises(ValueError, match="three groups"):
        association.mann_whitney_posthoc(df, "x", "g")
    with pytest.raises(ValueError, match="identical"):
        association.kruskal_wallis_test(
            spark.createDataFrame([(1, g) for g in "ABC"], "x int, g string"), "x", "g"
        )


def test_categorical_association(spark):
    rows = [("IT", "Senior")] * 18 + [("IT", "Junior")] * 2 + [("HR", "Senior")] * 2 + [("HR", "Junior")] * 18
    result = association.categorical_association(spark.createDataFrame(rows, "d string, l string"), "d", "l")
    r = one(result.test)
    assert r["n"] == 40 and r["chi_square"] == pytest.approx(22.5) and r["degrees_of_freedom"] == 1
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(22.5 / 2)))
    assert r["cramers_v"] == pytest.approx(math.sqrt(22.5 / 40))
    assert r["minimum_expected_count"] == 10


def test_empty_cells_count(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "y"), ("c", "x")]
    result = association.categorical_association(spark.createDataFrame(rows, "p string, q string"), "p", "q")
    seen = {(r["value_1"], r["value_2"]): r["n"] for r in result.table.collect()}
    assert seen == {("a", "x"): 2, ("b", "y"): 1, ("c", "x"): 1}
    grid = association.contingency_table(spark.createDataFrame(rows, "p string, q string"), "p", "q")
    table = {(r["value_1"], r["value_2"]): r["n"] for r in grid.collect()}
    assert table == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 1, ("c", "x"): 1, ("c", "y"): 0}
    assert one(result.test)["chi_square"] == pytest.approx(4.0)


def test_one_category_is_refused(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x")], "p string, q string")
    with pytest.raises(ValueError):
        association.categorical_association(df, "p", "q")


def test_binary_association(spark):
    rows = [(True, True)] * 15 + [(True, False)] * 5 + [(False, True)] * 5 + [(False, False)] * 15
    r = one(association.binary_association(spark.createDataFrame(rows, "t boolean, s boolean"), "t", "s").test)
    assert r["chi_square"] == pytest.approx(8.1) and r["phi"] == pytest.approx(math.sqrt(8.1 / 40))
    assert r["warning"] is None
    few = spark.createDataFrame(rows[:2] + rows[-2:], "t boolean, s boolean")
    assert one(association.binary_association(few, "t", "s").test)["warning"]


def test_binary_needs_two_values(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "p string, q int")
    with pytest.raises(ValueError, match="'p' must contain exactly two"):
        association.binary_association(df, "p", "q")


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([(v,) for v in p], "p double")

    def adjusted(method):
        return {r["p"]: r["adjusted_p_value"] for r in corrections.adjust(df, "p", 4, method).collect()}

    assert adjusted("holm") == pytest.approx({0.005: 0.02, 0.01: 0.03, 0.03: 0.06, 0.04: 0.06})
    assert adjusted("bonferroni") == pytest.approx({0.005: 0.02, 0.01: 0.04, 0.03: 0.12, 0.04: 0.16})
    assert adjusted("fdr_bh") == pytest.approx({0.005: 0.02, 0.01: 0.02, 0.03: 0.04, 0.04: 0.04})
    assert adjusted("sidak")[0.01] == pytest.approx(1 - 0.99**4)
    with pytest.raises(ValueError):
        corrections.adjust(df, "p", 4, "guess")


def plain_adjustment(p, method):
    """By the definitions, place by place."""
    m, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    q = [p[i] for i in order]
    if method in ("holm", "holm-sidak"):
        steps = [v * (m - i) if method == "holm" else 1 - (1 - v) ** (m - i) for i, v in enumerate(q)]
        out = [max(steps[: i + 1]) for i in range(m)]
    elif method == "hommel":
        out = []
        for i in range(m):  # closed testing: Simes over the worst sets of every size that hold i
            worst = q[i]
            for size in range(2, m + 1):
                held = sorted([q[i], *[v for j, v in enumerate(q) if j != i][-(size - 1):]])
                worst = max(worst, min(size * v / (j + 1) for j, v in enumerate(held)))
            out.append(worst)
    else:
        harmonic = sum(1 / i for i in range(1, m + 1)) if method == "fdr_by" else 1
        steps = [v * (m - i) if method == "simes-hochberg" else v * m / (i + 1) * harmonic for i, v in enumerate(q)]
        out = [min(steps[i:]) for i in range(m)]
    return {v: min(1.0, a) for v, a in zip(q, out)}


@pytest.mark.parametrize("method", ["holm", "holm-sidak", "simes-hochberg", "fdr_bh", "fdr_by", "hommel"])
@pytest.mark.parametrize("kind", ["uniform", "ties", "convex", "zeros"])
def test_corrections_in_buckets(spark, small_buckets, monkeypatch, method, kind):
    monkeypatch.setattr(corrections, "PLACES", 9)
    rng = random.Random(len(method) + len(kind))
    p = {
        "uniform": [rng.random() for _ in range(47)], "ties": [rng.choice([0.001, 0.01, 0.02, 0.5, 1.0]) for _ in range(60)],
        "convex": [((i + 1) / 50) ** 3 for i in range(50)], "zeros": [0.0] * 5 + [1e-5, 0.03] + [1.0] * 30,
    }[kind]
    rng.shuffle(p)
    df = spark.createDataFrame([(v, 0) for v in p] + [(None, 1)], "p double, n int")
    made = corrections.adjust(df, "p", len(p), method).collect()
    assert sorted(r["p"] for r in made if r["n"] == 0) == sorted(p)
    want = plain_adjustment(p, method)
    for r in made:
        assert r["adjusted_p_value"] == (None if r["p"] is None else pytest.approx(want[r["p"]], rel=1e-9))


def test_harmonic_numbers_meet():
    plain = sum(1 / i for i in range(1, 1_000_001))
    assert corrections._harmonic(1_000_000) == pytest.approx(plain, rel=1e-14)


def test_rank_sum_invariant(spark):
    data = spark.range(1000).selectExpr("cast(id % 37 as double) as x")
    cuts = ranks.boundaries(data, ["x"], 1000, 50)["x"]
    assert cuts == sorted(set(cuts)) and len(cuts) > 10
    ranked = ranks.centred_ranks(data, "x", 1000, cuts)
    total = ranked.agg(F.sum((F.col("rank") + 500.5) * F.col("ties"))).first()[0]
    assert total == 1000 * 1001 / 2


def test_buckets_count_the_cuts_below(spark):
    cuts = [0.0, 1.5, 3.0, 7.0, 9.0]
    values = [-1.0, 0.0, 0.1, 1.5, 2.9, 3.0, 6.9, 7.0, 8.0, 9.0, 50.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["_bucket"] for r in ranks.with_bucket(df, "x", cuts).collect()]
    assert got == [sum(c <= v for c in cuts) for v in values]


def test_stored_tables_in_buckets(spark, small_buckets, tmp_path):
    """Reading from files gives the optimizer more to infer than rows held in a plan."""
    rng = random.Random(6)
    rows = [(float(rng.randint(0, 60)), rng.choice("ABC"), rng.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "x double, g string, y double")
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for f in (
            lambda t: association.kruskal_wallis_test(t, "x", "g").test,
            lambda t: association.mann_whitney_posthoc(t, "x", "g").orderBy("group_1", "group_2"),
            lambda t: association.spearman_correlation(t, "x", "y"),
        ):
            for got, want in zip(f(stored).collect(), f(df).collect(), strict=True):
                for a, b in zip(got, want, strict=True):
                    assert a == (pytest.approx(b) if isinstance(b, float) else b)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

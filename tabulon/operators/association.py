"""Rank and contingency tests. Each reduces the table to one row before any p-value."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import special
from tabulon.functions import values as vx
from tabulon.operators import ranks
from tabulon.operators.corrections import adjust
from tabulon.operators.pair_ranks import bucket_rows, pair_rank_sums
from tabulon.session import materialise, ship_package

FEW_GROUPS = 12


def _numeric_and_group(df: DataFrame, numeric: str, group: str) -> DataFrame:
    vx.require_columns(df, [numeric, group])
    return df.select(
        vx.to_number(df, numeric).alias("x"), vx.present(df, group).alias("g")
    ).dropna()


# --- numeric with numeric -------------------------------------------------------------


def spearman_correlation(df: DataFrame, column_1: str, column_2: str) -> DataFrame:
    """Rank correlation of two columns on the rows where both are present. One row."""
    vx.require_columns(df, [column_1, column_2])
    data = df.select(
        vx.to_number(df, column_1).alias("x"), vx.to_number(df, column_2).alias("y")
    ).dropna()
    head = data.agg(
        F.count("*").alias("n"), F.min("x").alias("xa"), F.max("x").alias("xz"),
        F.min("y").alias("ya"), F.max("y").alias("yz"),
    ).first()
    n = head["n"]
    if n < 2:
        raise ValueError("At least two rows must hold both numbers.")
    if head["xa"] == head["xz"] or head["ya"] == head["yz"]:
        raise ValueError("A constant column has no rank variation to correlate.")
    cuts = ranks.boundaries(data, ["x", "y"], n)
    rx = ranks.centred_ranks(data.select("x"), "x", n, cuts["x"])
    ry = ranks.centred_ranks(data.select("y"), "y", n, cuts["y"])
    pairs = data.groupBy("x", "y").agg(F.count("*").alias("n"))
    joined = pairs.join(rx.select("x", F.col("rank").alias("rx")), "x").join(
        ry.select("y", F.col("rank").alias("ry")), "y"
    )
    sums = joined.agg(
        F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("xx"),
        F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("yy"),
    ).first()
    rho = max(-1.0, min(1.0, sums["xy"] / math.sqrt(sums["xx"]) / math.sqrt(sums["yy"])))
    if n == 2:
        p = float("nan")
    elif abs(rho) == 1.0:
        p = 0.0
    else:
        p = special.t_two_sided(rho * math.sqrt((n - 2) / ((1 - rho) * (1 + rho))), n - 2)
    return df.sparkSession.createDataFrame(
        [("spearman", column_1, column_2, n, rho, p)],
        "method string, column_1 string, column_2 string, n long, statistic double, p_value double",
    )


# --- numeric with groups --------------------------------------------------------------


PAIR_SCHEMA = (
    "group_1 string, group_2 string, group_1_n long, group_2_n long, group_1_median double, "
    "group_2_median double, statistic double, p_value double, rank_biserial double"
)


def _rank_sum_aggregates(first: str, second: str, u: str, ties: str):
    """U of the first group and the tie term, from counts per distinct value."""
    below = F.col(f"{second}_below").cast("double") + F.col(second) / F.lit(2.0)
    return [
        F.sum(F.col(first) * below).alias(u),
        ranks.tie_term(F.col(first) + F.col(second)).alias(ties),
    ]


def _middle(count: str, below: str, total):
    """Median of a group from running counts: mean of its two middle values."""
    values = []
    for position in (F.floor((total - 1) / 2), F.floor(total / 2)):
        hit = (F.col(below) <= position) & (position < F.col(below) + F.col(count))
        values.append(F.max(F.when(hit, F.col("x"))))
    return (values[0] + values[1]) / 2


def _group_name(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _counts_per_value(data: DataFrame, sizes: Sequence) -> tuple[list[str], DataFrame]:
    """One row per distinct value with a count column per group, from one shuffle."""
    counts = [f"c{i}" for i in range(len(sizes))]
    in_group = [F.count_if(F.col("g") == F.lit(g)) for g, _ in sizes]
    return counts, data.groupBy("x").agg(*[e.alias(c) for e, c in zip(in_group, counts, strict=True)])


def _compare_few_groups(data: DataFrame, sizes: Sequence) -> list[tuple]:
    """Mann-Whitney of all pairs of a few groups: (pair figures, p-value method) per pair.

    One shuffle makes a count per group for every distinct value; U, ties and medians of
    all pairs then come from one aggregate over the running counts. ``sizes`` lists
    (group, rows).
    """
    cuts = ranks.boundaries(data, ["x"], sum(n for _, n in sizes))["x"]
    counts, freq = _counts_per_value(data, sizes)
    pairs = list(combinations(range(len(sizes)), 2))
    aggregates = [
        _middle(c, f"{c}_below", F.lit(n)).alias(f"m{i}")
        for i, (c, (_, n)) in enumerate(zip(counts, sizes, strict=True))
    ]
    for i, j in pairs:
        aggregates += _rank_sum_aggregates(counts[i], counts[j], f"u{i}_{j}", f"t{i}_{j}")
    row = ranks.running_counts(freq, "x", counts, cuts).agg(*aggregates).first()
    lines = []
    for i, j in pairs:
        (g1, n1), (g2, n2) = sizes[i], sizes[j]
        u = row[f"u{i}_{j}"]
        p, method = special.mann_whitney_p(u, n1, n2, row[f"t{i}_{j}"])
        figures = (
            _group_name(g1), _group_name(g2), n1, n2, row[f"m{i}"], row[f"m{j}"], u, p,
            2 * u / n1 / n2 - 1,
        )
        lines.append((figures, method))
    return lines


def mann_whitney_test(df: DataFrame, numeric_column: str, binary_column: str) -> DataFrame:
    """Two-sided Mann-Whitney U with the rank-biserial effect size. One row.

    Groups are taken in ascending order of their value; ``p_method`` says whether the
    exact distribution or the tie- and continuity-corrected normal one was used.
    """
    data = _numeric_and_group(df, numeric_column, binary_column)
    sizes = data.groupBy("g").agg(F.count("*").alias("n")).orderBy("g").limit(3).collect()
    if len(sizes) != 2:
        raise ValueError("The groups to compare must be exactly two.")
    ((figures, method),) = _compare_few_groups(data, sizes)
    return df.sparkSession.createDataFrame(
        [("mann_whitney_u", numeric_column, binary_column, *figures, method)],
        f"method string, numeric_column string, group_column string, {PAIR_SCHEMA}, p_method string",
    )


@dataclass(frozen=True)
class KruskalResult:
    """``test``: one row. ``groups``: (group, n, median)."""

    test: DataFrame
    groups: DataFrame
    p_value: float


def _group_medians(data: DataFrame, sizes: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """(g, n, median) with every group cut into the same value buckets."""
    freq = data.groupBy("g", "x").agg(F.count("*").alias("c"))
    running = ranks.running_counts(freq, "x", ["c"], cuts, ["g"])
    return (
        running.join(sizes, "g")
        .groupBy("g", "n")
        .agg(_middle("c", "c_below", F.col("n")).alias("median"))
    )


def kruskal_wallis_test(
    df: DataFrame, numeric_column: str, categorical_column: str
) -> KruskalResult:
    """Tie-corrected Kruskal-Wallis H over three or more groups."""
    data = _numeric_and_group(df, numeric_column, categorical_column)
    sizes = data.groupBy("g").agg(F.count("*").alias("n"))
    listed = sizes.orderBy("g").limit(FEW_GROUPS + 1).collect()
    if len(listed) < 3:
        raise ValueError("Kruskal-Wallis compares at least three groups.")
    spark = df.sparkSession
    if len(listed) <= FEW_GROUPS:
        k, n = len(listed), sum(r["n"] for r in listed)
        between, ties, medians = _rank_few_groups(data, listed)
        groups = spark.createDataFrame(
            [(_group_name(r["g"]), r["n"], m) for r, m in zip(listed, medians, strict=True)],
            "group_name string, n long, median double",
        )
    else:
        k, n = sizes.agg(F.count("*"), F.sum("n")).first()
        cuts = ranks.boundaries(data, ["x"], n)["x"]
        between, ties = _rank_many_groups(data, n, cuts)
        groups = _group_medians(data, sizes, cuts).select(
            F.col("g").cast("string").alias("group_name"), "n", "median"
        )
    correction = 1.0 - ties / (float(n) ** 3 - n)
    if correction == 0:
        raise ValueError("All numbers are identical in kruskal.")
    h = 12.0 / (n * (n + 1.0)) * between / correction
    p = special.chi_square_tail(h, k - 1)
    test = spark.createDataFrame(
        [("kruskal_wallis", numeric_column, categorical_column, n, k, h, p)],
        "method string, numeric_column string, group_column string, n long, "
        "number_of_groups long, statistic double, p_value double",
    )
    return KruskalResult(test, groups, p)


def _rank_few_groups(data: DataFrame, sizes: Sequence) -> tuple[float, float, list[float]]:
    """Sum of squared centred rank sums over group sizes, tie term and group medians."""
    n = sum(r["n"] for r in sizes)
    cuts = ranks.boundaries(data, ["x"], n)["x"]
    counts, freq = _counts_per_value(data, sizes)
    freq = freq.withColumn("ties", reduce(Column.__add__, [F.col(c) for c in counts]))
    rank = F.col("ties_below") + (F.col("ties") + 1) / F.lit(2.0) - F.lit((n + 1) / 2.0)
    row = (
        ranks.running_counts(freq, "x", [*counts, "ties"], cuts)
        .withColumn("rank", rank)
        .agg(
            ranks.tie_term(F.col("ties")).alias("ties"),
            *[F.sum(F.col(c) * F.col("rank")).alias(f"r_{c}") for c in counts],
            *[
                _middle(c, f"{c}_below", F.lit(r["n"])).alias(f"m_{c}")
                for c, r in zip(counts, sizes, strict=True)
            ],
        )
        .first()
    )
    between = sum(row[f"r_{c}"] ** 2 / r["n"] for c, r in zip(counts, sizes, strict=True))
    return between, row["ties"], [row[f"m_{c}"] for c in counts]


def _rank_many_groups(data: DataFrame, n: int, cuts: Sequence[float]) -> tuple[float, float]:
    """The same two sums when a column per group would be too wide: ranks are joined on."""
    ranked = ranks.centred_ranks(data.select("x"), "x", n, cuts)
    c, t = F.col("c"), F.col("ties").cast("double")
    per_group = (
        data.groupBy("x", "g").agg(F.count("*").alias("c"))
        .join(ranked, "x")
        .groupBy("g")
        .agg(
            F.sum("c").alias("n"), F.sum(c * F.col("rank")).alias("r"),
            # the rows of a value add up to ties * (ties^2 - 1)
            F.sum(c * (t - 1.0) * (t + 1.0)).alias("ties"),
        )
    )
    return tuple(
        per_group.agg(F.sum(F.col("r") * F.col("r") / F.col("n")), F.sum("ties")).first()
    )


def mann_whitney_posthoc(
    df: DataFrame,
    numeric_column: str,
    categorical_column: str,
    alpha: float = 0.05,
    correction: str = "holm",
) -> DataFrame:
    """Mann-Whitney for every pair of groups with corrected p-values, one row per pair."""
    data = _numeric_and_group(df, numeric_column, categorical_column)
    spark = df.sparkSession
    sizes = data.groupBy("g").agg(F.count("*").alias("n"))
    listed = sizes.orderBy("g").limit(max(FEW_GROUPS, 2) + 1).collect()
    if len(listed) < 3:
        raise ValueError("Pairs are compared post hoc among at least three groups.")
    if len(listed) <= FEW_GROUPS:
        k, lines = len(listed), _compare_few_groups(data, listed)
        compared = spark.createDataFrame([(*figures, method) for figures, method in lines], f"{PAIR_SCHEMA}, p_method string")
    else:
        compared, k = _compare_many_groups(data, sizes)
    return adjust(compared, "p_value", k * (k - 1) // 2, correction, alpha).withColumn(
        "significant", F.col("adjusted_p_value") <= F.lit(alpha)
    )


def _compare_many_groups(data: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """Mann-Whitney of all pairs when one column per group would be too wide, and the number of groups.

    Values collapse to counts per (value, group), which meet in buckets of values.
    """
    ship_package(data.sparkSession)
    # The pairs are the result, so their square root of rows fits one window.
    index = materialise(sizes.select((F.row_number().over(Window.orderBy("g")) - 1).alias("i"), "g", "n"))
    k, total = index.agg(F.count("*"), F.sum("n")).first()
    cuts = ranks.boundaries(data, ["x"], total, bucket_rows(k))["x"]
    freq = data.groupBy("x", "g").agg(F.count("*").alias("c")).join(index, "g").select("x", "i", "c")
    tests = pair_rank_sums(freq, k, cuts)
    medians = _group_medians(data, index.select("g", "n"), cuts)
    named = index.join(medians.select("g", "median"), "g").select(
        "i", F.col("g").cast("string").alias("name"), "n", "median"
    )

    def side(key, group):
        return named.select(
            F.col("i").alias(key), F.col("name").alias(group), F.col("n").alias(f"{group}_n"),
            F.col("median").alias(f"{group}_median"),
        )

    @F.pandas_udf("double")
    def p_value(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(
            [special.mann_whitney_p(*args)[0] for args in zip(u, n1, n2, ties, strict=True)], dtype="float64"
        )

    compared = (
        tests.join(side("a", "group_1"), "a")
        .join(side("b", "group_2"), "b")
        .select(
            "group_1", "group_2", "group_1_n", "group_2_n", "group_1_median", "group_2_median",
            F.col("u").alias("statistic"),
            p_value("u", "group_1_n", "group_2_n", "ties").alias("p_value"),
            (2 * F.col("u") / F.col("group_1_n") / F.col("group_2_n") - 1).alias("rank_biserial"),
            F.when(
                (F.least("group_1_n", "group_2_n") <= special.EXACT_GROUP) & (F.col("ties") == 0), "exact"
            ).otherwise("normal").alias("p_method"),
        )
    )
    return compared, k


@dataclass(frozen=True)
class PosthocResult:
    global_test: KruskalResult
    posthoc: DataFrame | None


def kruskal_wallis_with_posthoc(
    df: DataFrame, numeric_column: str, categorical_column: str, alpha: float = 0.05
) -> PosthocResult:
    """Kruskal-Wallis, and the pairwise tests only when it is significant."""
    test = kruskal_wallis_test(df, numeric_column, categorical_column)
    pairs = None
    if test.p_value < alpha:
        pairs = mann_whitney_posthoc(df, numeric_column, categorical_column, alpha)
    return PosthocResult(test, pairs)


# --- categorical with categorical -----------------------------------------------------


@dataclass(frozen=True)
class ContingencyResult:
    """``test``: one row. ``table``: (value_1, value_2, n) of the cells that occur."""

    test: DataFrame
    table: DataFrame


def _cells(df: DataFrame, column_1: str, column_2: str) -> DataFrame:
    vx.require_columns(df, [column_1, column_2])
    return (
        df.select(vx.present(df, column_1).alias("a"), vx.present(df, column_2).alias("b"))
        .dropna()
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
    )


def _written(cells: DataFrame) -> DataFrame:
    return cells.select(
        F.col("a").cast("string").alias("value_1"), F.col("b").cast("string").alias("value_2"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def contingency_table(df: DataFrame, column_1: str, column_2: str) -> DataFrame:
    """The dense grid: every combination of the two columns' values, zero cells included.

    It has as many rows as the product of the distinct values; the tests need only the
    cells that occur and do not build it.
    """
    cells = materialise(_cells(df, column_1, column_2))
    grid = cells.select("a").distinct().join(cells.select("b").distinct())
    return _written(grid.join(cells, ["a", "b"], "left"))


def _chi_square(df: DataFrame, column_1: str, column_2: str) -> tuple[dict, DataFrame]:
    """Chi-square figures from the observed cells and their margins, and the cells.

    The source is aggregated once; margins and sums come from the cells.

    A cell that never occurs adds its expected count; those are what the observed cells
    leave of n. With one degree of freedom all four cells miss their expectation by the
    same amount, so the continuity-corrected sum needs the margins only.
    """
    cells = materialise(_cells(df, column_1, column_2))
    rows = cells.groupBy("a").agg(F.sum("n").alias("r"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("c"))
    row_side = rows.agg(
        F.count("*").alias("k"), F.sum("r").alias("n"), F.min("r").alias("low"),
        F.sum(1 / F.col("r")).alias("inverse"),
    ).first()
    column_side = columns.agg(
        F.count("*").alias("k"), F.min("c").alias("low"), F.sum(1 / F.col("c")).alias("inverse")
    ).first()
    n, k1, k2 = row_side["n"] or 0, row_side["k"], column_side["k"]
    result = {"n": n, "rows": k1, "columns": k2, "dof": (k1 - 1) * (k2 - 1)}
    if k1 < 2 or k2 < 2:
        return result, cells
    expected = F.col("r") * (F.col("c") / F.lit(float(n)))
    miss = F.col("n") - expected
    seen = (
        cells.join(rows, "a").join(columns, "b")
        .agg(
            F.count("*").alias("cells"),
            F.sum(miss * miss / expected).alias("chi"),
            F.sum(expected).alias("expected"),
            F.max(F.abs(miss)).alias("miss"),
        )
        .first()
    )
    chi = seen["chi"] + (n - seen["expected"] if seen["cells"] < k1 * k2 else 0.0)
    if result["dof"] == 1:
        miss = max(0.0, seen["miss"] - 0.5)
        chi = miss * miss * n * row_side["inverse"] * column_side["inverse"]
    result.update(
        chi_square=chi,
        p_value=special.chi_square_tail(chi, result["dof"]),
        minimum_expected=row_side["low"] * column_side["low"] / n,
    )
    return result, cells


def categorical_association(df: DataFrame, column_1: str, column_2: str) -> ContingencyResult:
    """Chi-square test of independence with Cramer's V (Yates-corrected when 2 x 2)."""
    f, cells = _chi_square(df, column_1, column_2)
    if f["rows"] < 2 or f["columns"] < 2:
        raise ValueError(
            "A test of independence needs two values or more in either column."
        )
    v = math.sqrt(f["chi_square"] / f["n"] / min(f["rows"] - 1, f["columns"] - 1))
    test = df.sparkSession.createDataFrame(
        [
            ("chi_square_cramers_v", column_1, column_2, f["n"], f["chi_square"], f["p_value"],
             f["dof"], v, f["minimum_expected"])
        ],
        "method string, column_1 string, column_2 string, n long, chi_square double, "
        "p_value double, degrees_of_freedom long, cramers_v double, minimum_expected_count double",
    )
    return ContingencyResult(test, _written(cells))


def binary_association(df: DataFrame, column_1: str, column_2: str) -> ContingencyResult:
    """Chi-square test and phi for two columns of two values each."""
    f, cells = _chi_square(df, column_1, column_2)
    for column, k in ((column_1, f["rows"]), (column_2, f["columns"])):
        if k != 2:
            raise ValueError(f"'{column}' must contain exactly two values.")
    warning = None
    if f["minimum_expected"] < 5:
        warning = "Some expected cell counts are below 5; an exact test may fit better."
    test = df.sparkSession.createDataFrame(
        [
            ("chi_square_phi", column_1, column_2, f["n"], f["chi_square"], f["p_value"],
             f["dof"], math.sqrt(f["chi_square"] / f["n"]), f["minimum_expected"], warning)
        ],
        "method string, column_1 string, column_2 string, n long, chi_square double, "
        "p_value double, degrees_of_freedom long, phi double, minimum_expected_count double, "
        "warning string",
    )
    return ContingencyResult(test, _written(cells))

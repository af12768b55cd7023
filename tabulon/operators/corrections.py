"""Corrections for many tests.

An adjusted p-value depends on the p-value and its place alone, so equal ones collapse to one
row with a count; places and running bounds then come from buckets of p-values with the totals
of the buckets before, and are joined to the tests. No window spans all tests and none are
collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators import ranks
from tabulon.session import materialise, ship_package

METHODS = (
    "holm", "bonferroni", "sidak", "holm-sidak", "simes-hochberg", "hommel", "fdr_bh", "fdr_by",
    "fdr_tsbh", "fdr_tsbky",
)
#: Places of the ordered p-values that one task of Hommel's procedure handles.
PLACES = 1_000_000


def _harmonic(m: int) -> float:
    """1 + 1/2 + ... + 1/m."""
    if m < 1_000_000:
        return math.fsum(1.0 / i for i in range(1, m + 1))
    return math.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m)


def _none_of(p: Column, tests: Column) -> Column:
    """1 - (1 - p)^tests."""
    return F.when(p >= 1, F.lit(1.0)).otherwise(-F.expm1(tests * F.log1p(-p)))


def _step(method: str, p: Column, m: int, below: Column, equal: Column) -> Column:
    """The bound of one p-value before its neighbours are looked at.

    Of equal ones the first place has the largest bound, which counts when stepping down,
    and the last the smallest, which counts when stepping up.
    """
    count = F.lit(float(m))
    if method == "holm":
        return p * (count - below)
    if method == "holm-sidak":
        return _none_of(p, count - below)
    last = below + equal
    if method == "simes-hochberg":
        return p * (count - last + 1)
    step = p * count / last
    return step * F.lit(_harmonic(m)) if method == "fdr_by" else step


def _frequencies(tests: DataFrame, p: str, m: int) -> tuple[DataFrame, list[float]]:
    """(p, n, n_below) per distinct p-value, and the values that cut them into buckets."""
    present = tests.select(F.col(f"`{p}`").cast("double").alias("p")).where("p IS NOT NULL AND NOT isnan(p)")
    cuts = ranks.boundaries(present, ["p"], m)["p"]
    freq = present.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return ranks.running_counts(freq, "p", ["n"], cuts), cuts


def adjust(
    tests: DataFrame, p: str, m: int, method: str = "holm", alpha: float = 0.05
) -> DataFrame:
    """Add ``adjusted_p_value`` for the m tests in the table (one row per test).

    ``alpha`` matters to the two-stage methods only, which estimate the true hypotheses by
    a first step at that level. A missing p-value has no place and no adjusted value.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown correction '{method}'; use one of {', '.join(METHODS)}.")
    value = F.col(f"`{p}`")
    if method in ("bonferroni", "sidak"):
        adjusted = value * F.lit(float(m)) if method == "bonferroni" else _none_of(value, F.lit(float(m)))
        return tests.withColumn("adjusted_p_value", F.least(adjusted, F.lit(1.0)))
    if method.startswith("fdr_ts"):
        factor = 1 + alpha if method == "fdr_tsbky" else 1.0
        first = adjust(tests, p, m, "fdr_bh")
        false = first.where(F.col("adjusted_p_value") <= alpha / factor).count()
        left = (m - false) / m if 0 < false < m else 1.0
        return first.withColumn("adjusted_p_value", F.least(F.col("adjusted_p_value") * F.lit(left * factor), F.lit(1.0)))
    freq, cuts = _frequencies(tests, p, m)
    if method == "hommel":
        found = _hommel(materialise(freq), m, cuts)
    else:
        down = method.startswith("holm")
        stepped = freq.select("p", _step(method, F.col("p"), m, F.col("n_below"), F.col("n")).alias("step"))
        order = [F.col("p") if down else F.col("p").desc()]
        found = ranks.running_extreme(stepped, "p", order, "step", cuts, down, down).select("p", F.col("step_run").alias("adjusted_p_value"))
    found = found.select(F.col("p").alias("_p"), F.least("adjusted_p_value", F.lit(1.0)).alias("adjusted_p_value"))
    return tests.join(found, value == F.col("_p"), "left").drop("_p")


# --- Hommel -------------------------------------------------------------------------------
#
# Let s(t) be Simes' p-value of all but the t smallest p-values: (m - t) times the least slope
# from the point (t, 0) to the points (r, r-th p-value) with r > t. It never falls as t grows.
# The adjusted value of p is the least of max(s(m - k - 1), k p) over k = 0 ... m, where s of
# all of them removed is 0: with the least k for which k p >= s(m - k - 1), it is
# min(k p, s(m - k)). Least slopes are tangents to the lower hull of the points.


def _lower_hull(held: pd.DataFrame) -> pd.DataFrame:
    """The points (r, p) that a lower tangent from the left can touch."""
    hull = []
    for r, p in held.sort_values("r", ascending=False)[["r", "p"]].itertuples(index=False):
        _push(hull, r, p)
    return pd.DataFrame(hull, columns=["r", "p"])


def _push(hull: list, r: int, p: float) -> None:
    """Add a point left of a hull whose points run from right to left."""
    while len(hull) > 1:
        (r1, p1), (r2, p2) = hull[-1], hull[-2]
        if (p1 - p) * (r2 - r) < (p2 - p) * (r1 - r):
            break
        hull.pop()
    hull.append((r, p))


def _tangents(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
    """(t, s) for the places of one block; rows without ``lo`` are hull points further right."""
    m = int(key[1])
    later = held[held["lo"].isna()].sort_values("r", ascending=False)
    hull: list = []
    for r, p in later[["r", "p"]].itertuples(index=False):
        _push(hull, r, p)
    places, slopes, touch = [], [], 0
    for lo, hi, r, p in held[held["lo"].notna()].sort_values("lo", ascending=False)[["lo", "hi", "r", "p"]].itertuples(index=False):
        if not hull or hull[-1][0] != r:
            _push(hull, r, p)
        touch = min(touch, len(hull) - 1)
        for t in range(int(hi) - 1, int(lo) - 1, -1):
            # From further left the tangent touches further left, that is later in the list.
            while touch + 1 < len(hull) and hull[touch + 1][1] * (hull[touch][0] - t) <= hull[touch][1] * (hull[touch + 1][0] - t):
                touch += 1
            places.append(t)
            slopes.append(hull[touch][1] / (hull[touch][0] - t))
    t = np.array(places, dtype=np.int64)
    return pd.DataFrame({"t": t, "s": (m - t) * np.array(slopes)})


def _hommel(freq: DataFrame, m: int, cuts: list[float]) -> DataFrame:
    """(p, adjusted_p_value) per distinct p-value; blocks of PLACES places are handled apart.

    A block also gets the hull points of the blocks after it, which are few unless the
    ordered p-values bend upwards everywhere.
    """
    ship_package(freq.sparkSession)
    last = F.col("n_below") + F.col("n")
    points = freq.select(last.alias("r"), "p", F.floor((last - 1) / PLACES).cast("long").alias("block"))
    blocks = (m - 1) // PLACES + 1
    own = freq.select(
        "p", last.alias("r"), "n_below", F.explode(F.sequence(F.floor(F.col("n_below") / PLACES), F.floor((last - 1) / PLACES))).alias("block")
    ).select(
        "block", F.greatest("n_below", F.col("block") * PLACES).alias("lo"), F.least("r", (F.col("block") + 1) * PLACES).alias("hi"), "r", "p"
    )
    if blocks > 1:
        hulls = points.groupBy("block").applyInPandas(lambda key, rows: _lower_hull(rows).assign(block=key[0]), "r long, p double, block long")
        later = hulls.where("block > 0").select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("block"), F.lit(None).cast("long").alias("lo"),
            F.lit(None).cast("long").alias("hi"), "r", "p",
        )
        own = own.unionByName(later)
    s = materialise(own.groupBy("block", F.lit(m).alias("m")).applyInPandas(_tangents, "t long, s double"))
    # The least k with k p >= s(m - k - 1), that is with s / k <= p: the bounds s / k fall as k grows.
    k = F.lit(m) - F.col("t") - 1
    empty = s.sparkSession.createDataFrame([(0.0, 0, m)], "x double, query int, k long")
    bounds = s.select((F.col("s") / F.nullif(k, F.lit(0))).alias("x"), F.lit(0).alias("query"), k.alias("k")).where("x IS NOT NULL")
    asked = freq.select(F.col("p").alias("x"), F.lit(1).alias("query"), F.lit(None).cast("long").alias("k"))
    merged = bounds.unionByName(empty).unionByName(asked)
    met = ranks.running_extreme(merged, "x", [F.col("x"), F.col("query")], "k", cuts, largest=False).where("query = 1")
    return met.join(s.select((F.lit(m) - F.col("t")).alias("k_run"), "s"), "k_run", "left").select(
        F.col("x").alias("p"), F.least(F.col("k_run") * F.col("x"), F.coalesce("s", F.lit(0.0))).alias("adjusted_p_value")
    )

"""Rank sums of every pair of many groups at once, as one product per bucket of values.

Of groups a and b, U is the sum over values v of c_a(v) * (below_b(v) + c_b(v) / 2), and the
tie term needs the sums of c_a(v)^2 * c_b(v). Both are products of one group's counts with
another's, so a bucket that holds the counts of all groups gives the figures of all pairs. A
count is sent to one bucket, not to each pair its group is in.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators import ranks
from tabulon.session import ship_package

#: Second groups that one task multiplies by; beyond it counts are sent to several tasks.
BLOCK_GROUPS = 512
#: Distinct values in one product.
BLOCK_VALUES = 2048
BUCKET_ROWS = 1 << 16


def bucket_rows(groups: int) -> int:
    """Rows of a bucket: enough that its counts outweigh the pairs it writes."""
    return max(BUCKET_ROWS, 4 * groups * groups)


def _products(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
    """(a, b, u, t) of the pairs whose second group is in the block, from one bucket."""
    first, width = key[1] * BLOCK_GROUPS, BLOCK_GROUPS
    known = held["x"].isna().to_numpy()
    below = np.zeros(width)
    below[held["i"].to_numpy()[known] - first] = held["c"].to_numpy()[known]
    counts = held[~known].sort_values("x", kind="stable")
    x = counts["x"].to_numpy()
    value = np.cumsum(np.r_[False, x[1:] != x[:-1]][: len(x)])
    group, count = counts["i"].to_numpy(), counts["c"].to_numpy(dtype=float)
    u, t = {}, {}
    lo = 0
    while lo < len(value):
        hi = int(np.searchsorted(value, value[lo] + BLOCK_VALUES))
        at, of, c = value[lo:hi] - value[lo], group[lo:hi], count[lo:hi]
        here = np.zeros((at[-1] + 1, width))
        inside = (of >= first) & (of < first + width)
        here[at[inside], of[inside] - first] = c[inside]
        halves = np.cumsum(here, axis=0) - here / 2 + below  # smaller ones, and half of the equal ones
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
        weight, rows = c[order, None], at[order]
        for a, us, ts in zip(
            of[order][starts], np.add.reduceat(weight * halves[rows], starts), np.add.reduceat(weight * weight * here[rows], starts),
            strict=True,
        ):
            u[a] = u.get(a, 0) + us
            t[a] = t.get(a, 0) + ts
        below = below + here.sum(axis=0)
        lo = hi
    groups = sorted(u)
    if not groups:
        return pd.DataFrame({"a": [], "b": [], "u": [], "t": []})
    a = np.repeat(np.array(groups), width)
    b = np.tile(np.arange(first, first + width), len(groups))
    us, ts = np.concatenate([u[g] for g in groups]), np.concatenate([t[g] for g in groups])
    kept = (a != b) & (b < key[2])
    a, b, us, ts = a[kept], b[kept], us[kept], ts[kept]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "u": np.where(a < b, us, 0.0), "t": ts})


def pair_rank_sums(counts: DataFrame, groups: int, cuts: Sequence[float]) -> DataFrame:
    """(a, b, u, ties) for every pair a < b of the groups 0 to ``groups`` - 1.

    ``counts`` has one row (x, i, c) per value and group: its rows. ``cuts`` are ascending
    values that balance the work. U is that of group a; ``ties`` is the sum of t^3 - t over
    the values of both groups. Every group has a row.
    """
    ship_package(counts.sparkSession)
    blocks = -(-groups // BLOCK_GROUPS)
    cut = ranks.with_bucket(counts, "x", cuts)
    per_group = counts.groupBy("i").agg(ranks.tie_term(F.col("c")).alias("own"))
    every = per_group.select("i", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("_bucket"))
    totals = cut.groupBy("i", "_bucket").agg(F.sum("c").alias("n"))
    # A group's totals, one row per bucket, added up over the buckets before.
    before = Window.partitionBy("i").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = every.join(totals, ["i", "_bucket"], "left").select(
        "_bucket", F.floor(F.col("i") / BLOCK_GROUPS).cast("int").alias("_block"), F.lit(None).cast("double").alias("x"), "i",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("c"),
    )
    rows = cut.select("_bucket", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), "x", "i", "c")
    keys = ["_bucket", "_block", F.lit(groups).alias("_groups")]
    made = rows.unionByName(below).groupBy(*keys).applyInPandas(_products, "a int, b int, u double, t double")
    pairs = made.groupBy("a", "b").agg(F.sum("u").alias("u"), F.sum("t").alias("t"))
    return (
        pairs.join(per_group.select(F.col("i").alias("a"), F.col("own").alias("own_a")), "a")
        .join(per_group.select(F.col("i").alias("b"), F.col("own").alias("own_b")), "b")
        .select("a", "b", "u", (F.col("own_a") + F.col("own_b") + 3 * F.col("t")).alias("ties"))
    )

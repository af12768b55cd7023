"""Running counts and average ranks over value frequencies.

Ties collapse first (one row per distinct value); values are then cut into buckets at
fixed boundaries, each bucket is summed on its own, and the bucket totals are
added back as offsets. No window ever spans the whole column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000


def boundaries(
    df: DataFrame, columns: Sequence[str], rows: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> dict[str, list[float]]:
    """Ascending cut values per column, or none when one bucket will do.

    They come from a sketch and only balance the work; any cut gives the same ranks.
    """
    buckets = 1
    while buckets * rows_per_bucket < rows:
        buckets *= 2
    if buckets == 1:
        return {c: [] for c in columns}
    shares = [i / buckets for i in range(1, buckets)]
    accuracy = max(1_000, 4 * buckets)
    row = df.agg(*[F.percentile_approx(c, shares, accuracy).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c])) for c in columns}


def with_bucket(df: DataFrame, x: str, cuts: Sequence[float]) -> DataFrame:
    """Add ``_bucket``: how many of the ascending, finite cut values are <= x, by binary search."""
    cuts = [c for c in cuts if math.isfinite(c)]
    if not cuts:
        return df.withColumn("_bucket", F.lit(0))
    splits = [float("-inf"), *map(float, cuts), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=x, outputCol="_bucket", handleInvalid="keep")
    return cut.transform(df).withColumn("_bucket", F.col("_bucket").cast("int"))


def running_counts(
    freq: DataFrame,
    x: str,
    counts: Sequence[str],
    cuts: Sequence[float] = (),
    part: Sequence[str] = (),
) -> DataFrame:
    """Add ``<count>_below``: the sum of a count over the smaller values of the same part.

    ``freq`` has one row per part and value of ``x``.
    """
    keys = [*part, "_bucket"]
    cut = with_bucket(freq, x, cuts)
    earlier = (
        Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = cut.select(
        "*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_below") for c in counts]
    )
    if not cuts:
        return inside.drop("_bucket")
    buckets = Window.partitionBy(*part, F.lit(0)).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        cut.groupBy(*keys)
        .agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
        .select(*keys, *[F.coalesce(F.sum(f"_t_{c}").over(buckets), F.lit(0)).alias(f"_o_{c}") for c in counts])
    )
    joined = inside.join(offsets, keys)
    return joined.select(
        *freq.columns,
        *[(F.col(f"{c}_below") + F.col(f"_o_{c}")).alias(f"{c}_below") for c in counts],
    )


def centred_ranks(
    data: DataFrame, x: str, total: int, cuts: Sequence[float] = ()
) -> DataFrame:
    """One row per distinct value: ``ties`` and its average rank minus (total + 1) / 2.

    Centring keeps the sums of ranks small, so their differences stay exact enough on
    very long columns.
    """
    freq = data.groupBy(x).agg(F.count("*").alias("ties"))
    ranked = running_counts(freq, x, ["ties"], cuts)
    rank = F.col("ties_below") + (F.col("ties") + 1) / F.lit(2.0)
    return ranked.select(x, "ties", (rank - F.lit((total + 1) / 2.0)).alias("rank"))


def tie_term(ties: Column) -> Column:
    """Sum of t^3 - t over rows that hold one distinct value each."""
    t = ties.cast("double")
    return F.sum(t * (t - 1.0) * (t + 1.0))


def running_extreme(
    rows: DataFrame, x: str, order: Sequence[Column], value: str, cuts: Sequence[float] = (),
    largest: bool = True, ascending: bool = True,
) -> DataFrame:
    """Add ``<value>_run``: the largest (or smallest) value of the rows up to this one.

    ``order`` sorts the rows of a bucket and must go the way of ``x`` that ``ascending`` says.
    """
    name, extreme, pick = f"{value}_run", (F.max if largest else F.min), (F.greatest if largest else F.least)
    cut = with_bucket(rows, x, cuts)
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumn(name, extreme(value).over(inside))
    if not cuts:
        return within.drop("_bucket")
    way = F.col("_bucket") if ascending else -F.col("_bucket")
    buckets = Window.partitionBy(F.lit(0)).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy("_bucket").agg(extreme(value).alias("_t")).select("_bucket", extreme("_t").over(buckets).alias("_carried"))
    return within.join(carried, "_bucket").select(*rows.columns, pick(name, "_carried").alias(name))

"""Balanced folds by position in a hash order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000


def number_rows(
    df: DataFrame, key: str, seed: int, rows: int, part: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``_number``: 0, 1, 2, ... in hash order of a unique key, per part.

    The hash spreads rows evenly over buckets however skewed the parts are; rows are
    numbered per bucket and shifted by the sizes of the buckets before it.
    """
    buckets = 1
    while buckets * rows_per_bucket < rows:
        buckets *= 2
    mixed = F.xxhash64(F.lit(seed), F.col(key))
    cut = df.withColumn("_hash", mixed).withColumn(
        "_bucket", F.coalesce(F.pmod("_hash", F.lit(buckets)).cast("int"), F.lit(0))
    )
    keys = [*part, "_bucket"]
    order = Window.partitionBy(*keys).orderBy("_hash", key)
    numbered = cut.withColumn("_number", F.row_number().over(order).cast("long") - 1)
    if buckets > 1:
        before = Window.partitionBy(*part, F.lit(0)).orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, -1
        )
        offsets = (
            cut.groupBy(*keys)
            .agg(F.count("*").alias("_size"))
            .select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
        )
        numbered = numbered.join(offsets, keys).withColumn("_number", F.col("_number") + F.col("_offset"))
    return numbered.select(*df.columns, "_number")


def class_sizes(df: DataFrame, target: str) -> DataFrame:
    """(label, n) of every class."""
    return df.groupBy(F.col(target).alias("label")).agg(F.count("*").alias("n"))


def assign_folds(
    df: DataFrame,
    task_type: str,
    key: str,
    target: str,
    requested_folds: int = 10,
    seed: int = 42,
    minimum_rows: int = 3,
    positions: bool = False,
) -> tuple[DataFrame, int, str | None]:
    """Add ``fold`` (0-based). Returns the table, the number of folds and a warning.

    Classification spreads every class evenly; fold sizes differ by at most one in all.
    ``key`` must tell the rows apart. ``positions`` also keeps where a row stands in its
    class (``_number``), where the class starts (``_start``) and its size (``_size``).
    """
    if requested_folds < 2:
        raise ValueError("Cross-validation takes two folds or more.")
    warning = None
    if task_type == "classification":
        sizes = class_sizes(df, target)
        smallest, rows = sizes.agg(F.min("n"), F.sum("n")).first()
        if smallest < 2:
            raise ValueError("A class of one row cannot be split into folds.")
        folds = min(requested_folds, smallest)
        if folds < requested_folds:
            warning = (
                f"Folds reduced from {requested_folds} to {folds} because of the smallest class."
            )
        # One row per class goes through this window, never the data.
        before = Window.partitionBy(F.lit(0)).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
        shift = sizes.select(
            F.col("label").alias(target), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"), F.col("n").alias("_size")
        )
        numbered = number_rows(df, key, seed, rows, [target]).join(shift, target)
        fold = F.pmod(F.col("_number") + F.col("_start"), F.lit(folds))
    elif task_type == "regression":
        rows = df.count()
        if rows < minimum_rows:
            raise ValueError(f"Folds need {minimum_rows} rows or more.")
        folds = min(requested_folds, rows)
        if folds < requested_folds:
            warning = f"Folds reduced from {requested_folds} to {folds}."
        numbered = number_rows(df, key, seed, rows).withColumns(
            {"_start": F.lit(0).cast("long"), "_size": F.lit(rows).cast("long")}
        )
        fold = F.pmod("_number", F.lit(folds))
    else:
        raise ValueError("Unknown task_type; it is classification or regression.")
    kept = ["_number", "_start", "_size"] if positions else []
    return numbered.select(*df.columns, *kept, fold.cast("int").alias("fold")), folds, warning


def validation_share(fold: int | None, folds: int, fraction: float):
    """Is a row validation data when ``fold`` (or none) is held out? A column over ``positions``.

    Rows of a class are evenly picked by their place among those left for training, so
    ceil(fraction * n) of every class with at least two rows are taken. Hash order makes
    the evenly spaced pick a random one, and no further sort or count is needed.
    """
    if not 0 < fraction < 0.5:
        raise ValueError("The validation share lies between 0 and 0.5.")
    if fold is None:
        rank, left = F.col("_number"), F.col("_size")
        return (left >= 2) & (F.ceil((rank + 1) * F.lit(fraction)) > F.ceil(rank * F.lit(fraction)))
    first = F.pmod(F.lit(fold) - F.col("_start"), F.lit(folds))  # first held-out place

    def held_out_before(place):
        return F.greatest(F.ceil((place - first) / F.lit(folds)), F.lit(0))

    rank = F.col("_number") - held_out_before(F.col("_number"))
    left = F.col("_size") - held_out_before(F.col("_size"))
    picked = F.ceil((rank + 1) * F.lit(fraction)) > F.ceil(rank * F.lit(fraction))
    return (F.col("fold") != fold) & (left >= 2) & picked


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(target, n, weight) with weight = rows / (classes * n)."""
    sizes = class_sizes(df, target)
    classes, total = sizes.agg(F.count("*"), F.sum("n")).first()
    return sizes.select(
        F.col("label").alias(target), "n", (F.lit(float(total or 0)) / (F.lit(classes) * F.col("n"))).alias("weight")
    )

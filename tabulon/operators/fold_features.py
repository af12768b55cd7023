"""Imputation, scaling and encoding for all folds of a cross-validation at once.

What is fitted on all folds but one follows from figures per fold: moments of the other folds
are merged, category counts lose those of the fold left out, and order statistics come from
value counts whose running totals leave a fold out. The table is read a fixed number of
times, whatever the number of folds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import values as vx
from tabulon.operators import ranks
from tabulon.operators.features import MAX_CATEGORIES, FittedFeatures, assemble, check_scaling, feature_values
from tabulon.session import store

Numbers = dict[str, tuple[float, float, float]]


def fit_features_by_fold(
    table: DataFrame, numeric: Sequence[str], categorical: Sequence[str], folds: int, scaling: str | None = "none",
    max_categories: int = MAX_CATEGORIES, fold: str = "fold",
) -> list[FittedFeatures]:
    """``fit_features`` of the rows outside each fold, for folds 0 to ``folds`` - 1.

    Equal to fitting each by itself, up to rounding in means and deviations.
    """
    scaling = check_scaling(scaling)
    vx.require_columns(table, [*numeric, *categorical, fold])
    numbers, texts = feature_values(table, numeric, categorical)
    by_number = _numbers_by_fold(table, numbers, folds, scaling, fold)
    by_text = _categories_by_fold(table, texts, folds, max_categories, fold)
    return [assemble(table, n, c) for n, c in zip(by_number, by_text, strict=True)]


def _categories_by_fold(
    table: DataFrame, texts: dict[str, Column], folds: int, max_categories: int, fold: str
) -> list[dict[str, tuple[str, list[str]]]]:
    if not texts:
        return [{} for _ in range(folds)]
    limit = max_categories * len(texts)
    cells = [F.struct(F.lit(c).alias("column_name"), x.alias("value")) for c, x in texts.items()]
    rows = (
        table.select(F.col(fold).alias("_f"), F.inline(F.array(*cells))).where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.array(*[F.count_if(F.col("_f") == f) for f in range(folds)]).alias("n"))
        .limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise ValueError(
            f"The categorical columns hold more than {max_categories} values each; leave out "
            "keys and free text or raise max_categories."
        )
    out = []
    for f in range(folds):
        left: dict[str, dict[str, int]] = {}
        for r in rows:
            others = sum(r["n"]) - r["n"][f]
            if others:
                left.setdefault(r["column_name"], {})[r["value"]] = others
        out.append({c: (min(n, key=lambda v: (-n[v], v)), sorted(n)) for c in texts if (n := left.get(c))})
    return out


def _merged(parts: list[tuple[int, float, float]]) -> tuple[float, float]:
    """Mean and population deviation of the union of parts given as (n, mean, variance)."""
    n = sum(k for k, _, _ in parts)
    mean = math.fsum(k * m for k, m, _ in parts) / n
    return mean, math.sqrt(math.fsum(k * (v + (m - mean) ** 2) for k, m, v in parts) / n)


class _Places:
    """Order statistics of (column, fold left out) from one stored table of running counts."""

    def __init__(self, running: DataFrame):
        self.running = running

    def values(self, wanted: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], dict[int, float]]:
        """The values at the wanted places (from 0) among those outside a fold."""
        aggregates, names = [], []
        for (c, f), places in wanted.items():
            for place in sorted(set(places)):
                here = (F.col("c") == c) & (F.col(f"t{f}_below") <= place) & (F.col(f"t{f}_below") + F.col(f"t{f}") > place)
                aggregates.append(F.max(F.when(here, F.col("x"))).alias(f"v{len(names)}"))
                names.append((c, f, place))
        row = self.running.agg(*aggregates).first() if names else []
        out: dict[tuple[int, int], dict[int, float]] = {}
        for value, (c, f, place) in zip(row, names, strict=True):
            out.setdefault((c, f), {})[place] = value
        return out

    def below(self, cuts: dict[tuple[int, int], float]) -> dict[tuple[int, int], int]:
        """How many values outside the fold are smaller than the given one."""
        asked = list(cuts.items())
        row = self.running.agg(*[
            F.coalesce(F.sum(F.when((F.col("c") == c) & (F.col("x") < F.lit(cut)), F.col(f"t{f}"))), F.lit(0)) for (c, f), cut in asked
        ]).first()
        return {key: n for (key, _), n in zip(asked, row, strict=True)}


def _numbers_by_fold(table: DataFrame, numbers: dict[str, Column], folds: int, scaling: str, fold: str) -> list[Numbers]:
    if not numbers:
        return [{} for _ in range(folds)]
    names = list(numbers)
    cells = table.select(F.col(fold).alias("_f"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), x.cast("double").alias("x")) for i, x in enumerate(numbers.values())
    ])))
    stats = {
        (r["c"], r["_f"]): r
        for r in cells.groupBy("c", "_f").agg(
            F.count(F.lit(1)).alias("rows"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"),
            F.min("x").alias("low"), F.max("x").alias("high"),
        ).collect()  # one row per column and fold
    }
    present = cells.where("x IS NOT NULL")
    cuts = ranks.boundaries(present, ["x"], sum(s["n"] for s in stats.values()))["x"]
    own = present.groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_f") == f).alias(f"f{f}") for f in range(folds)])
    left = [f"t{f}" for f in range(folds)]
    freq = own.select("c", "x", *[(F.col("n") - F.col(f"f{f}")).alias(f"t{f}") for f in range(folds)])
    held = store(ranks.running_counts(freq, "x", left, cuts, ["c"]))
    try:
        return _from_places(_Places(held.table), stats, names, folds, scaling)
    finally:
        held.drop()


def _from_places(places: _Places, stats: dict, names: list[str], folds: int, scaling: str) -> list[Numbers]:
    others = {(c, f): [stats[c, g] for g in range(folds) if g != f and (c, g) in stats] for c in range(len(names)) for f in range(folds)}
    size = {key: sum(s["n"] for s in parts) for key, parts in others.items()}
    rows = {key: sum(s["rows"] for s in parts) for key, parts in others.items()}
    filled = [key for key in others if size[key]]
    middle = {key: [(size[key] - 1) // 2, size[key] // 2] for key in filled}
    found = places.values(middle)
    fills = {key: found[key][a] + (found[key][b] - found[key][a]) * 0.5 for key, (a, b) in middle.items()}
    pairs = {}
    if scaling == "robust" and filled:
        smaller = places.below(fills)
        wanted, spots = {}, {}
        for key in filled:
            gaps = rows[key] - size[key]
            spots[key] = [q * (rows[key] - 1) for q in (0.25, 0.5, 0.75)]
            ends = {e for spot in spots[key] for e in (math.floor(spot), math.ceil(spot))}
            # The filled gaps stand together, after the values that are smaller than the fill.
            wanted[key] = {e: e if e < smaller[key] else None if e < smaller[key] + gaps else e - gaps for e in ends}
        found = places.values({key: [p for p in ends.values() if p is not None] for key, ends in wanted.items()})
        for key in filled:
            at = {e: fills[key] if p is None else found[key][p] for e, p in wanted[key].items()}
            q1, mid, q3 = (at[math.floor(s)] + (at[math.ceil(s)] - at[math.floor(s)]) * (s - math.floor(s)) for s in spots[key])
            pairs[key] = (mid, q3 - q1)
    for key in filled:
        parts = [s for s in others[key] if s["n"]]
        if scaling == "none":
            pairs[key] = (0.0, 1.0)
        elif scaling == "standard":
            pairs[key] = _merged([*[(s["n"], s["mean"], s["variance"]) for s in parts], (rows[key] - size[key], fills[key], 0.0)])
        elif scaling == "minmax":
            low, high = min(s["low"] for s in parts), max(s["high"] for s in parts)
            pairs[key] = (low, high - low)
    return [
        {names[c]: (fills[c, f], pairs[c, f][0], pairs[c, f][1] or 1.0) for c in range(len(names)) if (c, f) in fills}
        for f in range(folds)
    ]


def scaling_by_fold(
    table: DataFrame, columns: Sequence[str], folds: int, scaling: str | None = "standard", fold: str = "fold"
) -> DataFrame:
    """(fold, column_name, fill, centre, scale) of the rows outside each fold; empty columns have no line."""
    numbers, _ = feature_values(table, columns, [])
    fitted = _numbers_by_fold(table, numbers, folds, check_scaling(scaling), fold)
    lines = [(f, c, *figures) for f, found in enumerate(fitted) for c, figures in found.items()]
    return table.sparkSession.createDataFrame(lines, "fold int, column_name string, fill double, centre double, scale double")

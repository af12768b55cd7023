"""Exact quantiles of any number of columns without gathering a column in one task.

Every wanted order statistic is held between two data values. While too many rows lie
between them, one aggregate over the table (a mergeable sketch plus two counts, no
shuffle of rows) moves the two values closer. Only the rows left between them are then
counted per value and ordered, a bounded number however large the table is.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 2_000


@dataclass
class _Range:
    """Rows [low, high] of one column; ``below`` rows are smaller, ``upto`` are not larger."""

    low: float
    high: float
    below: int
    upto: int

    @property
    def inside(self) -> int:
        return self.upto - self.below


def _narrow(df, exprs, todo, slack):
    """One sketch and one count of the table propose closer values for every open place.

    Places that lie in the same range of the same column share a sketch.
    """
    shared: dict[tuple, list] = {}
    for (name, position), r in todo:
        share = (position - r.below + 0.5) / r.inside
        ends = shared.setdefault((name, r.low, r.high), [])
        ends.append((position, max(0.0, share - slack), min(1.0, share + slack)))
    row = df.agg(
        *[
            F.percentile_approx(
                F.when(exprs[name].between(low, high), exprs[name]),
                [p for _, first, last in ends for p in (first, last)],
                SKETCH_ACCURACY,
            ).alias(f"s{i}")
            for i, ((name, low, high), ends) in enumerate(shared.items())
        ]
    ).first()
    found = {}
    for i, ((name, _, _), ends) in enumerate(shared.items()):
        for j, (position, _, _) in enumerate(ends):
            found[(name, position)] = row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1]
    counts = []
    for i, ((name, _), (low, high)) in enumerate(found.items()):
        x = exprs[name]
        counts += [F.count_if(x < low).alias(f"b{i}"), F.count_if(x <= high).alias(f"u{i}")]
    seen = df.agg(*counts).first()
    return {
        key: _Range(*ends, seen[f"b{i}"], seen[f"u{i}"]) for i, (key, ends) in enumerate(found.items())
    }


def exact_quantiles(
    df: DataFrame,
    exprs: Mapping[str, Column],
    probabilities: Sequence[float],
    known: Mapping[str, tuple] | None = None,
    max_rows: int = 1_000_000,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of numeric expressions.

    ``known`` may give (count, min, max) per name when an earlier pass has them. Each
    result list follows ``probabilities``; a column without values gives None.
    """
    names = list(exprs)
    if not names:
        return {}
    # Named once, so that no pass evaluates a costly expression twice per row.
    df = df.select(*[exprs[n].cast("double").alias(f"q{i}") for i, n in enumerate(names)])
    doubles = {n: F.col(f"q{i}") for i, n in enumerate(names)}
    if known is None:
        row = df.agg(
            *[
                f(doubles[n]).alias(f"{tag}{i}")
                for i, n in enumerate(names)
                for tag, f in (("n", F.count), ("a", F.min), ("z", F.max))
            ]
        ).first()
        known = {n: (row[f"n{i}"], row[f"a{i}"], row[f"z{i}"]) for i, n in enumerate(names)}

    wanted: dict[tuple[str, int], _Range] = {}
    for name in names:
        count, low, high = known[name]
        if not count:
            continue
        for p in probabilities:
            at = (count - 1) * p
            for position in {math.floor(at), math.ceil(at)}:
                wanted[(name, position)] = _Range(float(low), float(high), 0, count)

    slack = 2.0 / SKETCH_ACCURACY
    while True:
        todo = [(k, r) for k, r in wanted.items() if r.inside > max_rows and r.low < r.high]
        if not todo:
            break
        closer = _narrow(df, doubles, todo, slack)
        for key, old in todo:
            new = closer[key]
            if new.below <= key[1] < new.upto and new.inside < old.inside:
                wanted[key] = new
        if all(wanted[key] is old for key, old in todo):
            slack *= 4.0
            if slack > 1.0:
                break

    found = {k: r.low for k, r in wanted.items() if r.low == r.high}
    found.update(_read_ranges(df, doubles, {k: r for k, r in wanted.items() if k not in found}))

    result: dict[str, list[float | None]] = {}
    for name in names:
        count = known[name][0]
        if not count:
            result[name] = [None] * len(probabilities)
            continue
        values = []
        for p in probabilities:
            at = (count - 1) * p
            low, high = found[(name, math.floor(at))], found[(name, math.ceil(at))]
            values.append(low if low == high else low + (high - low) * (at - math.floor(at)))
        result[name] = values
    return result


def _read_ranges(df, doubles, wanted):
    """Order the rows inside the final ranges and pick the wanted positions."""
    if not wanted:
        return {}
    ranges = {}
    for (name, _), r in wanted.items():
        ranges.setdefault((name, r.low, r.high), len(ranges))
    cells = [
        F.struct(
            F.lit(i).alias("part"),
            F.when(doubles[name].between(low, high), doubles[name]).alias("x"),
        )
        for (name, low, high), i in ranges.items()
    ]
    freq = (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("x").isNotNull())
        .groupBy("part", "x")
        .agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("part").orderBy("x")
    running = freq.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    places = df.sparkSession.createDataFrame(
        [
            (ranges[(name, r.low, r.high)], position - r.below, name, position)
            for (name, position), r in wanted.items()
        ],
        "part int, place long, name string, position long",
    )
    hits = running.join(F.broadcast(places), "part").where(
        (F.col("place") >= F.col("upto") - F.col("n")) & (F.col("place") < F.col("upto"))
    )
    # At most two rows per column and probability reach the driver.
    return {(h["name"], h["position"]): h["x"] for h in hits.select("name", "position", "x").collect()}

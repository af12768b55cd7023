"""Forests whose trees are grown whole, each by one task, on binned and counted rows.

A tree sees a row by the bins of its features only, so rows of equal bins, label and weight
are one entry with a count; the sum of the Poisson draws of n rows is one Poisson draw of
mean n. What a tree does is MLlib's: bins from about 10,000 rows, a bootstrap by Poisson draws,
a random subset of the features per node, the largest gain in Gini impurity or variance,
sibling leaves of equal prediction merged, votes by the leaves' class shares. A level costs a
task what its entries cost, not a histogram of all bins per node and partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import new_path, remove, ship_package, store

#: Bytes of binned features and class weights that a task may hold, at most.
TASK_BYTES = 100_000_000
#: Distinct rows that are scored together, about.
BLOCK_ROWS = 1_000_000
CHUNK_BYTES = 64_000_000
_PLACES = 1 << 40
_ARRAYS = (("feature", np.int32), ("cut", np.int32), ("child", np.int32), ("value", np.float64))
TREE = "part int, tree int, " + ", ".join(f"{n} binary" for n, _ in _ARRAYS) + ", importances binary, size long"


def cut_points(values: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 cuts half-way between values, so that bins hold about as many rows.

    ``low`` and ``high`` are those of all rows: a column whose other value the sample missed
    still has one cut.
    """
    found, counts = np.unique(values, return_counts=True)
    if len(found) < 2:
        return np.array([low + (high - low) / 2]) if low < high else np.empty(0)
    middles = found[:-1] + (found[1:] - found[:-1]) / 2
    if len(middles) < bins:
        return middles
    upto, share = np.cumsum(counts).tolist(), len(values) / bins
    cuts, wanted = [], share
    for middle, before, after in zip(middles.tolist(), upto, upto[1:], strict=False):
        # A value that fills several bins leaves their cuts to the values after it.
        if abs(before - wanted) < abs(after - wanted):
            cuts.append(middle)
            wanted += share
    return np.array(cuts)


@dataclass(frozen=True)
class Bins:
    """Cuts per feature, and where a feature's bin stands in the whole numbers that name a row."""

    cuts: list[np.ndarray]
    places: list[tuple[int, int]]  # (number of the long, first bit) per feature
    longs: int

    @classmethod
    def of(cls, cuts: Sequence[np.ndarray]) -> Bins:
        places, number, bit = [], 0, 0
        for c in cuts:
            width = len(c).bit_length()
            if bit + width > 63:
                number, bit = number + 1, 0
            places.append((number, bit))
            bit += width
        return cls(list(cuts), places, number + 1)

    @property
    def most(self) -> int:
        return max(len(c) for c in self.cuts) + 1

    @property
    def names(self) -> list[str]:
        return [f"__k{i}" for i in range(self.longs)]

    def columns(self, features: Column) -> dict[str, Column]:
        """The longs of a row, by name."""
        values = vector_to_array(features)
        return {name: self._packing(i)(values) for i, name in enumerate(self.names)}

    def _packing(self, number: int):
        def packed(rows: pd.Series) -> pd.Series:
            return _packed(self, number, rows)

        return F.pandas_udf(packed, "long")

    def codes(self, longs: Sequence[np.ndarray]) -> np.ndarray:
        """(row, feature): the bins again."""
        made = np.empty((len(longs[0]), len(self.cuts)), np.uint8 if self.most <= 256 else np.uint16)
        for f, ((number, bit), c) in enumerate(zip(self.places, self.cuts, strict=True)):
            made[:, f] = (longs[number] >> bit) & ((1 << len(c).bit_length()) - 1)
        return made


def _packed(bins: Bins, number: int, rows: pd.Series) -> pd.Series:
    out = np.zeros(len(rows), np.int64)
    if len(rows):
        values = np.stack(rows.to_numpy())
        for f, (at, bit) in enumerate(bins.places):
            if at == number:
                out |= np.searchsorted(bins.cuts[f], values[:, f]).astype(np.int64) << bit
    return pd.Series(out)


# --- one tree --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Nodes by level; -1 is the feature of a leaf, ``child`` the left child or the leaf's line of ``value``."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    importances: np.ndarray

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Class shares, or the predicted number, of every row."""
        node = np.zeros(len(codes), np.int64)
        moving = np.arange(len(codes)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while len(moving):
            at = node[moving]
            node[moving] = after = self.child[at] + (codes[moving, self.feature[at]] > self.cut[at])
            moving = moving[self.feature[after] >= 0]
        return self.value[self.child[node]]


def _worth(sums: Sequence[np.ndarray], classes: bool) -> np.ndarray:
    """Weight times what the prediction explains; its rise by a split is weight times gain."""
    if not classes:
        return sums[1] * sums[1] / sums[0]
    return sum(a * a for a in sums) / sum(sums)


def _best_cut(key, slot, sums, totals, nodes, bins, classes):
    """Per node the largest worth of a split on its bins, and the bin it cuts after."""
    if nodes * bins <= 4 * len(key):
        here = np.bincount(key, minlength=nodes * bins).reshape(nodes, bins).cumsum(1)
        node, cut = np.nonzero((here[:, :-1] > 0) & (here[:, :-1] < here[:, -1:]))
        left = [np.bincount(key, a, nodes * bins).reshape(nodes, bins).cumsum(1)[node, cut] for a in sums]
    else:
        order = np.argsort(key, kind="stable")
        ordered, at = key[order], slot[order]
        new = at[1:] != at[:-1]
        ends = np.flatnonzero((ordered[1:] != ordered[:-1]) & ~new)
        node, cut = at[ends], ordered[ends] - at[ends] * bins
        begins = np.flatnonzero(new) + 1
        left = []
        for a in sums:
            running = a[order].cumsum()
            before = np.zeros(nodes)
            before[at[begins]] = running[begins - 1]
            left.append(running[ends] - before[node])
    worth, chosen = np.full(nodes, -np.inf), np.zeros(nodes, np.int64)
    if len(node):
        with np.errstate(divide="ignore", invalid="ignore"):
            found = _worth(left, classes) + _worth([t[node] - a for t, a in zip(totals, left, strict=True)], classes)
        found[~np.isfinite(found)] = -np.inf
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        top = np.maximum.reduceat(found, first)
        worth[node[first]] = top
        hits = np.flatnonzero(found == np.repeat(top, np.diff(np.append(first, len(node)))))[::-1]
        chosen[node[hits]] = cut[hits]
    return worth, chosen


def grow_tree(codes: np.ndarray, stats: Sequence[np.ndarray], classes: bool, bins: int, tried: int, depth: int, rng) -> Tree:
    """A tree over distinct rows of bins, level by level.

    ``stats`` are per row the weight of each class, or the weight, weighted sum and weighted
    square sum of the numbers. ``tried`` features are drawn for each node.
    """
    width = codes.shape[1]
    flat = codes.ravel()
    cell = np.flatnonzero(sum(stats) > 0 if classes else stats[0] > 0)
    sums, slot, nodes = [a[cell] for a in stats], np.zeros(len(cell), np.int64), 1
    levels = []
    while nodes:
        totals = [np.bincount(slot, a, nodes) for a in sums]
        weight = sum(totals) if classes else totals[0]
        level = {"feature": np.full(nodes, -1), "cut": np.zeros(nodes, np.int64), "totals": totals, "gain": np.zeros(nodes)}
        levels.append(level)
        worth = _worth(totals, classes)
        unlike = weight - worth if classes else totals[2] - worth  # weight times impurity
        whole = weight if classes else totals[2]
        mixed = (unlike > 1e-12 * whole) & (np.bincount(slot, minlength=nodes) > 1)
        if len(levels) > depth or not mixed.any():
            break
        kept = mixed[slot]
        cell, slot, sums = cell[kept], (np.cumsum(mixed) - 1)[slot[kept]], [a[kept] for a in sums]
        open_ = np.flatnonzero(mixed)
        count = len(open_)
        drawn = np.broadcast_to(np.arange(width), (count, width)) if tried >= width else np.sort(np.argpartition(rng.random((count, width)), tried - 1, axis=1)[:, :tried])
        best, feature, cut = np.full(count, -np.inf), np.zeros(count, np.int64), np.zeros(count, np.int64)
        of_open = [t[open_] for t in totals]
        used, slack = len(sums) if classes else 2, 1e-10 * unlike[open_]
        for j in range(drawn.shape[1]):
            f = drawn[:, j]
            key = slot * bins + flat[cell * width + f[slot]]
            found, at = _best_cut(key, slot, sums[:used], of_open[:used], count, bins, classes)
            better = found > best + slack  # of equal splits that of the first feature
            best[better], feature[better], cut[better] = found[better], f[better], at[better]
        rise = best - worth[open_]
        split = rise > 1e-12 * unlike[open_]
        at = open_[split]
        level["feature"][at], level["cut"][at], level["gain"][at] = feature[split], cut[split], rise[split]
        kept = split[slot]
        cell, slot, sums = cell[kept], slot[kept], [a[kept] for a in sums]
        right = flat[cell * width + feature[slot]] > cut[slot]
        slot = 2 * (np.cumsum(split) - 1)[slot] + right
        nodes = 2 * len(at)
    return _finished(levels, classes, width)


def _finished(levels: list[dict], classes: bool, width: int) -> Tree:
    """Sibling leaves of equal prediction merged from below, the nodes left numbered by level."""
    for level in levels:
        t = level["totals"]
        level["says"] = np.argmax(t, axis=0) if classes else t[1] / t[0]
    for level, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
        at = np.flatnonzero(level["feature"] >= 0)
        leaf, says = below["feature"].reshape(-1, 2) < 0, below["says"].reshape(-1, 2)
        merged = leaf.all(axis=1) & (says[:, 0] == says[:, 1])
        below["gone"] = np.repeat(merged, 2)
        level["feature"][at[merged]], level["gain"][at[merged]] = -1, 0.0
        level["parents"] = at
    feature, cut, child, values, importances, numbered, leaves = [], [], [], [], np.zeros(width), 0, 0
    for i, level in enumerate(levels):
        left = ~level["gone"] if "gone" in level else np.ones(len(level["feature"]), bool)
        f = level["feature"][left]
        inner = f >= 0
        ends = [t[left][~inner] for t in level["totals"]]
        numbered += len(f)
        follow = np.empty(len(f), np.int64)
        follow[inner] = numbered + 2 * np.arange(inner.sum())
        follow[~inner] = leaves + np.arange((~inner).sum())
        leaves += int((~inner).sum())
        values.append(np.stack([a / sum(ends) for a in ends], axis=1) if classes else (ends[1] / ends[0])[:, None])
        np.add.at(importances, f[inner], level["gain"][left][inner])
        for out, part in ((feature, f), (cut, level["cut"][left]), (child, follow)):
            out.append(part.astype(np.int32))
    whole = importances.sum()
    return Tree(*(np.concatenate(x) for x in (feature, cut, child, values)), importances / whole if whole else importances)


# --- many trees ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Growth:
    """What a task must know to grow trees."""

    bins: Bins
    classes: int  # 0 for numbers
    tried: int
    depth: int
    seed: int
    trees: dict[int, list[tuple[int, int]]]  # (part, tree) by the group's key


def _distinct(longs: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of several columns, and the number of each row's."""
    _, first, number = np.unique(longs[0], return_index=True, return_inverse=True)
    for more in longs[1:]:
        known, place = np.unique(more, return_inverse=True)
        _, first, number = np.unique(number * len(known) + place, return_index=True, return_inverse=True)
    return [x[first] for x in longs], number


def _grow(growth: Growth, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    column = {n: table.column(n).to_numpy() for n in table.column_names}
    names = growth.bins.names
    for group in np.unique(column["group"]):
        mine = column["group"] == group
        label, weight, n = (column[c][mine] for c in ("label", "weight", "n"))
        cells, cell = _distinct([column[k][mine] for k in names])
        order = np.lexsort((weight, label, cell))  # draws do not depend on the order of arrival
        label, weight, n, cell = (a[order] for a in (label, weight, n, cell))
        codes = growth.bins.codes(cells)
        middle = 0.0 if growth.classes else float(np.average(label, weights=n))
        for part, tree in growth.trees[int(group)]:
            rng = np.random.default_rng([growth.seed & 0xFFFFFFFF, tree])
            drawn = rng.poisson(n)
            if not drawn.any():
                drawn = n  # a table so small that no row was drawn
            w = drawn * weight
            size = len(codes)
            if growth.classes:
                at = label.astype(np.int64) * size + cell
                stats = list(np.bincount(at, w, growth.classes * size).reshape(growth.classes, size))
            else:
                y = label - middle
                stats = [np.bincount(cell, x, size) for x in (w, w * y, w * y * y)]
            made = grow_tree(codes, stats, bool(growth.classes), growth.bins.most, growth.tried, growth.depth, rng)
            value = made.value if growth.classes else made.value + middle
            arrays = [a.astype(t).tobytes() for a, (_, t) in zip((made.feature, made.cut, made.child, value), _ARRAYS, strict=True)]
            fields = [pa.array([part], pa.int32()), pa.array([tree], pa.int32()), *[pa.array([a], pa.binary()) for a in arrays]]
            fields += [pa.array([made.importances.tobytes()], pa.binary()), pa.array([sum(map(len, arrays))], pa.int64())]
            yield pa.RecordBatch.from_arrays(fields, names=[c.split()[0] for c in TREE.split(", ")])


def _score(bins: Bins, width: int, rows: pa.Table, trees: pa.Table) -> pa.Table:
    """The sum of the trees' scores of every distinct row."""
    longs = [rows.column(n).to_numpy() for n in bins.names]
    votes = np.zeros((len(longs[0]), width))
    codes = bins.codes(longs)
    chunk = rows.column("chunk")
    order = np.argsort(trees.column("tree").to_numpy(), kind="stable")
    for i in order:
        feature, cut, child, value = (np.frombuffer(trees.column(n)[int(i)].as_buffer(), t) for n, t in _ARRAYS)
        votes += Tree(feature, cut, child, value.reshape(-1, width), np.empty(0)).scores(codes)
    ends = np.arange(0, votes.size + 1, width, dtype=np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(votes.ravel()))
    return pa.table([*[rows.column(n) for n in bins.names], chunk, listed], names=[*bins.names, "chunk", "votes"])


def group_keys(spark: SparkSession, groups: int) -> list[int]:
    """A key per group, each in a partition of its own when there are as many partitions as groups."""
    asked = 16 * groups + 64
    while True:
        place = F.pmod(F.hash(F.col("id")), F.lit(groups)).alias("place")
        found = {place: key for key, place in sorted(spark.range(0, asked, 1, 1).select("id", place).collect(), reverse=True)}
        if len(found) == groups:
            return [found[i] for i in range(groups)]
        asked *= 2


@dataclass(frozen=True)
class GrownTrees:
    """Trees in the shared folder, a folder per part; ``importances``: the sum over the trees."""

    bins: Bins
    classes: int
    path: str
    parts: list[tuple[str, int]]
    importances: np.ndarray
    size: int

    def scores(self, spark: SparkSession, keyed: DataFrame, rows: int) -> DataFrame:
        """(longs, votes): the sum of all trees' scores per distinct row of ``keyed``."""
        ship_package(spark)
        names, trees = self.bins.names, sum(n for _, n in self.parts)
        chunks = min(trees, max(spark.sparkContext.defaultParallelism, self.size // CHUNK_BYTES + 1))
        blocks = rows // BLOCK_ROWS + 1
        keys = F.array(*[F.lit(k) for k in group_keys(spark, chunks * blocks)])
        block = F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")
        every = F.sequence(F.lit(0), F.lit(chunks - 1))
        split = keyed.select(*names).distinct().withColumn("block", block).withColumn("chunk", F.explode(every))
        split = split.withColumn("group", F.get(keys, F.col("chunk") * blocks + F.col("block"))).drop("block")
        held = spark.read.schema(TREE.removeprefix("part int, ")).parquet(*[p for p, _ in self.parts])
        held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        held = held.withColumn("group", F.get(keys, F.pmod("tree", F.lit(chunks)) * blocks + F.col("block")))
        sides = [d.repartition(chunks * blocks, "group").groupBy("group") for d in (split, held.drop("importances", "size", "block"))]
        schema = ", ".join([*[f"{n} long" for n in names], "chunk int", "votes array<double>"])
        bins, width = self.bins, max(self.classes, 1)
        made = sides[0].cogroup(sides[1]).applyInArrow(lambda rows, trees: _score(bins, width, rows, trees), schema)
        added = made.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("chunk", "votes"))).alias("v"))
        none = F.array_repeat(F.lit(0.0), max(self.classes, 1))
        return added.select(*names, F.aggregate("v", none, lambda a, b: F.zip_with(a, b["votes"], lambda x, y: x + y)).alias("votes"))

    def drop(self, spark: SparkSession) -> None:
        remove(spark, self.path)


def _sample(held: DataFrame, key: str, seed: int, share: float) -> np.ndarray:
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(_PLACES))
    rows = held if share >= 1 else held.where(place < F.lit(int(share * _PLACES)))
    found = rows.select(vector_to_array("features").alias("x")).toArrow().column("x").combine_chunks()
    return found.flatten().to_numpy().reshape(len(found), -1)


def is_plain(estimator) -> bool:
    """Are the estimator's settings those that ``grow_trees`` follows?"""
    return (
        estimator.getImpurity() in ("gini", "variance") and estimator.getFeatureSubsetStrategy() in ("sqrt", "all")
        and estimator.getSubsamplingRate() == 1.0 and estimator.getBootstrap() and estimator.getMinInstancesPerNode() == 1
        and estimator.getMinInfoGain() == 0.0 and estimator.getMinWeightFractionPerNode() == 0.0
    )


def grow_trees(
    held: DataFrame, estimator, label: str, key: str, weight: str | None, classes: int, sizes: Sequence[int], drawn: float
) -> GrownTrees | None:
    """Grow parts of ``sizes`` trees over a stored table; None if it is too wide for tasks.

    With ``drawn`` below 1 each part draws its own share of the rows by a hash of the key.
    """
    spark = held.sparkSession
    ship_package(spark)
    stats = Summarizer.metrics("count", "min", "max").summary(F.col("features")).alias("s")
    row = held.agg(stats).first()["s"]
    low, high = row["min"].toArray(), row["max"].toArray()
    width, most = len(low), estimator.getMaxBins()
    wanted = max(most * most, 10_000)
    room = row["count"] * drawn * (width * (1 + (most > 256)) + 8 * classes)
    if not width or room > TASK_BYTES or wanted * width * 8 > 4 * TASK_BYTES:
        return None
    seed = estimator.getSeed()
    sample = _sample(held, key, seed, min(1.0, wanted / row["count"]))
    bins = Bins.of([cut_points(sample[:, f], low[f], high[f], min(most, row["count"])) for f in range(width)])
    tried = width if estimator.getFeatureSubsetStrategy() == "all" else int(np.ceil(np.sqrt(width)))
    packed = held.select(
        *[c.alias(n) for n, c in bins.columns(F.col("features")).items()], F.col(label).alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).alias("weight"), F.col(key).alias("id"),
    )
    numbers = [(part, tree) for part, (n, before) in enumerate(zip(sizes, np.cumsum([0, *sizes]), strict=False)) for tree in range(int(before), int(before) + n)]
    path, cores = new_path(spark, "forest"), spark.sparkContext.defaultParallelism
    counted = [*bins.names, "label", "weight"]

    def write(entries, keys, trees):
        growth = Growth(bins, classes, tried, estimator.getMaxDepth(), seed, trees)
        made = entries.repartition(len(keys), "group").mapInArrow(partial(_grow, growth), TREE)
        made.write.partitionBy("part").mode("append").parquet(path)

    if drawn >= 1:
        groups = min(len(numbers), cores)
        keys = group_keys(spark, groups)
        edges = [i * len(numbers) // groups for i in range(groups + 1)]
        entries = packed.groupBy(*counted).agg(F.count(F.lit(1)).alias("n"))
        entries = entries.withColumn("group", F.explode(F.array(*[F.lit(k) for k in keys])))
        write(entries, keys, {k: numbers[a:b] for k, a, b in zip(keys, edges, edges[1:], strict=False)})
    else:
        once = store(packed)
        for begin in range(0, len(sizes), cores):
            some = list(range(begin, min(begin + cores, len(sizes))))
            keys = group_keys(spark, len(some))
            chosen = [
                F.when(F.pmod(F.xxhash64(F.lit(seed + part), "id"), F.lit(_PLACES)) < F.lit(int(drawn * _PLACES)), F.lit(k))
                for part, k in zip(some, keys, strict=True)
            ]
            entries = once.table.select(*counted, F.explode(F.array_compact(F.array(*chosen))).alias("group"))
            entries = entries.groupBy(*counted, "group").agg(F.count(F.lit(1)).alias("n"))
            write(entries, keys, {k: [x for x in numbers if x[0] == part] for part, k in zip(some, keys, strict=True)})
        once.drop()
    found = sorted(spark.read.schema(TREE).parquet(path).select("tree", "importances", "size").collect())
    if len(found) != len(numbers):
        raise RuntimeError(f"{len(numbers)} trees were to be grown, {len(found)} were.")
    importances = np.sum([np.frombuffer(r["importances"]) for r in found], axis=0)
    parts = [(f"{path}/part={i}", n) for i, n in enumerate(sizes)]
    return GrownTrees(bins, classes, path, parts, importances, sum(r["size"] for r in found))

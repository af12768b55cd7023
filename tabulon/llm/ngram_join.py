"""Near-duplicate join on word n-grams: exact Jaccard through count vectors in an R-tree.

A text's set of word shingles is hashed into groups; the counts per group are a point. The
overlap of two sets is at most the sum of the coordinate minima of their points, and that
of two boxes at most the sum of minima of their upper corners, so boxes and points that
cannot reach the threshold fall away before any set is compared.

Points of unrelated texts all lie about equally far apart, so boxes over the whole corpus
would prune nothing. The upper levels of the tree are therefore cut by the same groups: if
two sets differ in at most d shingles, then of d + 1 groups one has the same content in
both. Each set has one 64-bit key per group (within its band of sizes); the sets that share
a key are a run, and fall into one subtree. Boxes and points split a subtree into parts that the bound
connects, and only the sets of such parts are built and compared. All steps are lossless.
Equal sets are one point, whatever their number.

The 32 counts of long texts are alike by chance. So a point also has the parities of the counts
of as many groups as its set has shingles, or more: where two parities differ, the sets do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.groups import Scratch, attach_groups, components
from tabulon.llm.texthash import NOT_SPACE, Words, blocks, mix
from tabulon.llm.workers import prepare
from tabulon.session import materialise

#: Coordinates of a point.
GROUPS = 32
#: Points in a leaf of the distributed tree, and shingles in it.
LEAF_POINTS = 512
LEAF_SHINGLES = 500_000
#: Points in a box inside a task.
BOX_POINTS = 16
#: Bits of the filter that finds the texts of candidates without shuffling texts (1 MB).
FILTER_BITS = 1 << 23
#: Heads that a set is checked against before the search; more only save comparisons later.
HEADS = 3
#: Rows of one Python group.
TASK_POINTS = 2_000

_ORDER = np.array([0x9E3779B97F4A7C15 * (2 * k + 3) % 2**64 | 1 for k in range(64)], np.uint64)
_SECOND = np.uint64(0x5851F42D4C957F2D)
_THIRD = np.uint64(0xD1342543DE82EF95)
_EMPTY = np.uint64(0xA0761D6478BD642F)


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def shingle_sets(column: pa.Array, words: int):
    """(row, sorted distinct shingle hashes) of each text; fewer words make one shingle."""
    for lo, _, data, offsets in blocks(column):
        parts = Words(data, offsets, NOT_SPACE)
        h, counts, bounds = parts.hashes(), parts.counts(), parts.bounds
        total = len(h)
        shingles = np.zeros(max(0, total - words + 1), np.uint64)
        for k in range(words):
            shingles += h[k : total - words + 1 + k] * _ORDER[k]
        shingles = mix(shingles)
        for d in range(len(counts)):
            a, n = bounds[d], counts[d]
            if n >= words:
                yield lo + d, np.unique(shingles[a : a + n - words + 1])
            elif n:
                whole = (h[a : a + n] * _ORDER[:n] + np.uint64(n)).sum(dtype=np.uint64, keepdims=True)
                yield lo + d, mix(whole)
            else:
                yield lo + d, np.zeros(0, np.uint64)


def _print(values: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set."""
    return values.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(values ^ _SECOND)) if len(values) else np.uint64(0)


class Bands:
    """Size bands, so that linked sets lie in one band or in neighbouring ones."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        upper, low = [], 1
        while low < largest:
            upper.append(max(low, low * 100 // percent))
            low = upper[-1] + 1
        self.upper, self.percent = np.array(upper), percent

        self._known: dict[int, tuple[int, int]] = {}

    def instances(self, size: int) -> list[tuple[int, int]]:
        """(instance, number of groups); instances in which only equal sets link are left out."""
        band = int(np.searchsorted(self.upper, size))
        return [(k, m) for k in (band - 1, band) if k >= 0 and (m := self.groups(k))]

    def _plan(self, k: int) -> tuple[int, int]:
        """(groups, spare ones) of an instance: one group more than linked sets can differ
        in, and room for empty groups, five deviations above what the smallest set expects
        (small sets get less room)."""
        if k not in self._known:
            most = 2 * int(self.upper[k + 1]) * (100 - self.percent) // (100 + self.percent)
            least = int(self.upper[k - 1]) + 1 if k else 1
            mean = (most + 1) * float(np.exp(-least / (most + 1)))
            spare = min(int(1.5 * mean + 5 * mean**0.5) + 1, 4 + most // 3)
            self._known[k] = (most + 1 + spare, spare) if most else (0, 0)
        return self._known[k]

    def groups(self, k: int) -> int:
        return self._plan(k)[0]

    def spare(self, k: int) -> int:
        return self._plan(k)[1]


def group_keys(values: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a sorted set: one per group of each instance that is not empty.

    As long as one of two sets has no more empty groups than the spare ones, they share a
    group that is not empty. Sets with more (hardly any) have a key in common for that.
    """
    spread = mix(values ^ _THIRD)
    out = []
    for k, m in bands.instances(len(values)):
        cuts = np.searchsorted(values, (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64))
        cuts = np.concatenate(([0], cuts))
        full = np.diff(np.concatenate((cuts, [len(values)]))) > 0
        salt = np.uint64((k + 1) * 0x632BE59BD9B4E019 % 2**64)
        at = np.flatnonzero(full)
        out.append(mix(np.add.reduceat(spread, cuts[at]) + salt + at.astype(np.uint64) * _SECOND))
        if m - len(at) > bands.spare(k):
            out.append(mix(np.array([salt ^ _EMPTY])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _point(values: np.ndarray) -> np.ndarray:
    """Shingles per group."""
    return np.bincount((values & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def _parity(values: np.ndarray) -> bytes:
    """Parities of the counts in a power of two of groups, one or two a shingle (64 at least)."""
    width = max(64, 1 << (len(values) - 1).bit_length()) if len(values) else 64
    counts = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(parities: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities for fewer groups: 64 * ``words`` of them."""
    if parities.shape[1] == words:
        return parities
    return np.bitwise_xor.reduce(parities.reshape(len(parities), -1, words), axis=1)


def _rows_of(parities) -> np.ndarray:
    """Parities of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(parities), "<u8").reshape(len(parities), -1)


def _differing(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many shingles the sets of two rows of parities differ at least."""
    words = min(one.shape[1], other.shape[1])
    return np.bitwise_count(_folded(one, words) ^ _folded(other, words)).sum(1, dtype=np.int64)


def _prints(words: int):
    def run(batches):
        for batch in batches:
            n, one, two, point, parity = [], [], [], [], []
            for _, values in shingle_sets(batch.column(1), words):
                a, b = _print(values)
                n.append(len(values)), one.append(a), two.append(b), point.append(_point(values)), parity.append(_parity(values))
            flat = pa.array(np.concatenate(point) if point else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(_signed(one)), pa.array(_signed(two)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * GROUPS), flat),
                    pa.array(parity, pa.binary()),
                ],
                ["doc_id", "n_shingles", "one", "two", "point", "parity"],
            )
    return run


def _keys(words: int, percent: int):
    def run(batches):
        bands, seen = Bands(percent), set()
        for batch in batches:
            keys, nodes, held = [], [], 0
            for _, values in shingle_sets(batch.column(0), words):
                node = _print(values)[0]
                if len(values) == 0 or node in seen:
                    continue  # a copy: its keys are out already
                seen.add(node)
                keys.append(group_keys(values, bands))
                nodes.append(np.full(len(keys[-1]), node))
                held += len(keys[-1])
                if held > 200_000:
                    yield _pairs(keys, nodes)
                    keys, nodes, held = [], [], 0
            yield _pairs(keys, nodes)
    return run


def _pairs(keys, nodes):
    none = [np.zeros(0, np.uint64)]
    return pa.RecordBatch.from_arrays(
        [pa.array(_signed(np.concatenate(keys or none))), pa.array(_signed(np.concatenate(nodes or none)))], ["key", "node"]
    )


def _run_links(batches):
    """(key, node, first node of the run) over rows sorted by key and node, a node once a run; runs may cross batches."""
    last_key, last_node, root = None, None, None
    for batch in batches:
        key, node = (np.asarray(batch.column(k)) for k in (0, 1))
        if not len(key):
            continue
        new = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
        again = np.concatenate(([last_node is not None and node[0] == last_node], node[1:] == node[:-1])) & ~new
        first = np.where(new, node, 0)
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        roots = np.where(at >= 0, first[np.maximum(at, 0)], root if root is not None else 0)
        linked = (node != roots) & ~again
        last_key, last_node, root = key[-1], node[-1], roots[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[linked]) for x in (key, node, roots)], ["key", "a", "b"])


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over the hash of ``node``; the driver gets its words only."""
    bits = ids.select(F.xxhash64("node").alias("h")).selectExpr(
        f"explode(array(h & {FILTER_BITS - 1}, shiftrightunsigned(h, 32) & {FILTER_BITS - 1})) AS bit"
    )
    words = bits.selectExpr("bit div 64 AS word", "shiftleft(1L, CAST(bit % 64 AS INT)) AS mask")
    table = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)
    return out


def _may_hold(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64)
    found = np.ones(len(h), bool)
    for bit in (h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)):
        found &= (held[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return found


def _sets(words: int, wanted):
    """(node, its print, shingles) rows of wanted ids; few at a time, as they are as large as
    the texts. The filter lets some others through; the join after it drops them."""
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_may_hold(wanted.value, np.asarray(batch.column(2)))))
            rows, sets, held = [], [], 0
            for row, values in shingle_sets(batch.column(1), words):
                rows.append(row), sets.append(values)
                held += len(values)
                if held > 1_000_000:
                    yield _set_rows(batch, rows, sets)
                    rows, sets, held = [], [], 0
            yield _set_rows(batch, rows, sets)
    return run


def _set_rows(batch, rows, sets):
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    flat = _signed(np.concatenate(sets) if sets else [])
    prints = [_signed([p[k] for p in map(_print, sets)]) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(rows, pa.int64())), pa.array(prints[0]), pa.array(prints[1]),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
        ],
        ["node", "print_a", "print_b", "shingles"],
    )


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _by_width(parities) -> tuple[np.ndarray, dict[int, tuple[int, np.ndarray]]]:
    """Words of each of the rows, which come by size, and per width the first row so wide with the
    parities of all from there on, folded to it."""
    widths = np.array([len(p) // 8 for p in parities])
    out, wider = {}, None
    for words in np.unique(widths)[::-1].tolist():
        first, end = np.searchsorted(widths, [words, words + 1]).tolist()
        own = _rows_of(parities[first:end])
        wider = own if wider is None else np.concatenate((own, _folded(wider, words)))
        out[words] = first, wider
    return widths, out


def tree_links(ids, sizes, points, sets, side, percent: int, known=None, parities=None) -> list[tuple[int, int]]:
    """Links that connect what is connected at the threshold, from boxes down to sets.

    Pairs already connected, by a found link or because they are ``known`` to be in one
    component, are not compared. ``side`` is None for all pairs, else only pairs across it
    count. Without ``sets`` the bounds of the points and their ``parities`` decide.
    """
    order = np.lexsort((points[:, 0], sizes))
    sizes, points = sizes[order].astype(np.int64), points[order].astype(np.int64)
    ids = [ids[k] for k in order]
    sets = None if sets is None else [np.asarray(sets[k]).view(np.uint64) for k in order]
    side = None if side is None else np.asarray(side)[order]
    widths, folded = _by_width([parities[k] for k in order]) if parities is not None else (None, None)
    parent = list(range(len(ids)))
    if known is not None:
        first: dict = {}
        for k, group in enumerate(np.asarray(known)[order].tolist()):
            parent[k] = first.setdefault(group, k)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    starts = np.arange(0, len(ids), BOX_POINTS)
    corner = np.maximum.reduceat(points, starts)
    least = np.minimum.reduceat(sizes, starts)
    most = np.maximum.reduceat(sizes, starts)
    need, whole = percent, 100 + percent
    out = []
    for i, at in enumerate(starts):
        bound = np.minimum(corner[i], corner[i:]).sum(1) * whole >= need * (least[i] + least[i:])
        near = np.flatnonzero(bound & (most[i] * 100 >= least[i:] * percent)) + i
        if not len(near):
            continue
        others = np.concatenate([np.arange(starts[j], min(starts[j] + BOX_POINTS, len(ids))) for j in near])
        for a in range(at, min(at + BOX_POINTS, len(ids))):
            later = others[others > a]
            if side is not None:
                later = later[side[later] != side[a]]
            minima = np.minimum(points[a], points[later]).sum(1)
            fits = (minima * whole >= need * (sizes[a] + sizes[later])) & (sizes[a] * 100 >= sizes[later] * percent)
            later, minima = later[fits], minima[fits]
            if folded and len(later):
                first, rows = folded[int(widths[a])]
                apart = np.bitwise_count(rows[later - first] ^ rows[a - first]).sum(1, dtype=np.int64)
                fits = apart * whole <= (100 - percent) * (sizes[a] + sizes[later])
                later, minima = later[fits], minima[fits]
            for b in later[np.argsort(-minima, kind="stable")]:
                x, y = root(a), root(int(b))
                if x == y:
                    continue
                if sets is None or _overlap(sets[a], sets[b]) * whole >= need * (sizes[a] + sizes[b]):
                    parent[y] = x
                    out.append((ids[a], ids[b]))
    return out


def _search(percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        links = []
        for (_, one, other), rows in part.groupby(["subtree", "one", "other"], sort=False):
            links += tree_links(
                rows["node"].tolist(), rows["n"].to_numpy(), np.stack(rows["point"].to_numpy()),
                rows["shingles"].tolist() if "shingles" in rows else None,
                None if one == other else rows["leaf"].to_numpy(), percent, rows["known"].to_numpy(), rows["parity"].tolist(),
            )
        return pd.DataFrame({"a": [a for a, _ in links], "b": [b for _, b in links]}, dtype="int64")
    return run


def _bound(minima: Column, one: Column, other: Column, percent: int) -> Column:
    """May sets of these sizes link, if they share at most ``minima`` shingles?"""
    return (minima * (100 + percent) >= percent * (one + other)) & (one * 100 >= other * percent) & (other * 100 >= one * percent)


def _minima(one: str, other: str) -> Column:
    return F.aggregate(F.zip_with(one, other, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def _boxes(members: DataFrame, keys: list[str]) -> DataFrame:
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("held"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.array(*[F.max(F.col("point")[g]) for g in range(GROUPS)]).alias("corner"),
    )


def _near_boxes(one: DataFrame, other: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Pairs of boxes with equal ``keys`` whose bound allows a link; columns end in _1 and _2."""
    left = one.select(*keys, *[F.col(c).alias(f"{c}_1") for c in one.columns if c not in keys])
    right = other.select(*keys, *[F.col(c).alias(f"{c}_2") for c in other.columns if c not in keys])
    return left.join(right, keys).where(
        f"most_1 * 100 >= least_2 * {percent} AND most_2 * 100 >= least_1 * {percent}"
    ).where(_minima("corner_1", "corner_2") * (100 + percent) >= percent * (F.col("least_1") + F.col("least_2")))


def _leaf_pairs(leaves: DataFrame, percent: int) -> DataFrame:
    """Pairs of leaves whose boxes may hold a linked pair of different components.

    A unit is a component with leaves of its own, or all small ones of a subtree (-1). Units
    are paired first, so the leaves of a large component never meet each other.
    """
    units = leaves.groupBy("subtree", "unit").agg(
        F.sum("held").alias("held"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.array(*[F.max(F.col("corner")[g]) for g in range(GROUPS)]).alias("corner"),
    )
    apart = _near_boxes(units, units, ["subtree"], percent).where("unit_1 < unit_2").select("subtree", "unit_1", "unit_2")
    small = leaves.where("unit < 0")
    inside = _near_boxes(small, small, ["subtree"], percent).where("leaf_1 < leaf_2 OR (leaf_1 = leaf_2 AND held_1 > 1)")
    kept = ["subtree", "leaf_1", "leaf_2", "held_1", "held_2"]
    left = apart.join(leaves.withColumnRenamed("unit", "unit_1"), ["subtree", "unit_1"])
    left = left.select("subtree", F.col("unit_2").alias("unit"), *[F.col(c).alias(f"{c}_1") for c in ("leaf", "held", "least", "most", "corner")])
    right = leaves.select("subtree", "unit", *[F.col(c).alias(f"{c}_2") for c in ("leaf", "held", "least", "most", "corner")])
    across = left.join(right, ["subtree", "unit"]).where(
        f"most_1 * 100 >= least_2 * {percent} AND most_2 * 100 >= least_1 * {percent}"
    ).where(_minima("corner_1", "corner_2") * (100 + percent) >= percent * (F.col("least_1") + F.col("least_2")))
    return inside.select(*kept).unionByName(across.select(*kept)).select(
        "subtree", F.col("leaf_1").alias("one"), F.col("leaf_2").alias("other"), (F.col("held_1") + F.col("held_2")).alias("held")
    )


def _search_tree(points: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) links between components of a subtree, of (subtree, known, node, n, point, parity and perhaps shingles).

    ``known`` is the component a node is already in. A large component is cut into leaves of
    its own; small ones share leaves, cut by size. Leaves hold about LEAF_POINTS points or
    LEAF_SHINGLES shingles, and a subtree of no more is one leaf; a task gets two leaves whose
    boxes may hold a link, or one.
    """
    columns = [c for c in ("known", "node", "n", "point", "parity", "shingles") if c in points.columns]

    def leaves_of(rows):
        weight = F.sum("n") / LEAF_SHINGLES if "shingles" in columns else F.lit(0.0)
        return F.ceil(F.greatest(rows / LEAF_POINTS, weight)).cast("long")

    total = points.count()
    known = scratch.keep(
        points.groupBy("subtree", "known").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), leaves_of(F.count(F.lit(1))).alias("parts"))
        .withColumn("unit", F.when(F.col("parts") > 1, F.col("known")).otherwise(F.lit(-1).cast("long")))
    )
    trees = scratch.keep(known.groupBy("subtree").agg(F.count(F.lit(1)).alias("held"), leaves_of(F.sum("rows")).alias("leaves")))
    known = scratch.keep(
        attach_groups(known, trees, ["subtree"], "held", known.count())
        .select("subtree", "known", "rows", "unit", (F.col("leaves") == 1).alias("single"))
    )
    # Sizes are cut by bands of a fixed ratio, and a band by hashes into as many leaves as it needs.
    band = F.floor(F.log(F.col("n").cast("double")) * 8).cast("long")
    in_units = attach_groups(points, known, ["subtree", "known"], "rows", total).drop("rows").withColumn(
        "band", F.when((F.col("unit") < 0) & ~F.col("single"), band).otherwise(F.lit(0).cast("long"))
    )
    parts = scratch.keep(
        in_units.groupBy("subtree", "unit", "band").agg(F.count(F.lit(1)).alias("rows"), leaves_of(F.count(F.lit(1))).alias("leaves"))
        .withColumn("first", F.sum("leaves").over(
            Window.partitionBy("subtree").orderBy("unit", "band").rowsBetween(Window.unboundedPreceding, -1)))
    )
    # Known components stay together in a leaf of small ones, so that it needs no pair with itself for them.
    members = attach_groups(in_units, parts, ["subtree", "unit", "band"], "rows", total).withColumn(
        "leaf", F.coalesce("first", F.lit(0)) + F.pmod(F.xxhash64(F.when(F.col("unit") < 0, F.col("known")).otherwise(F.col("node"))), F.col("leaves"))
    ).select("subtree", "unit", "leaf", *columns)
    boxes = scratch.keep(_boxes(members, ["subtree", "unit", "leaf"]))
    pairs = scratch.keep(_leaf_pairs(boxes, percent))
    columns = ["subtree", "one", "other", "leaf", *columns]
    placed = (
        members.join(pairs.withColumn("leaf", F.col("one")), ["subtree", "leaf"]).select(*columns)
        .unionByName(members.join(pairs.where("one <> other").withColumn("leaf", F.col("other")), ["subtree", "leaf"]).select(*columns))
    )
    held = pairs.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    place = F.pmod(F.xxhash64("subtree", "one", "other"), F.lit(held // TASK_POINTS + 1))
    return placed.groupBy(place.alias("place")).applyInPandas(_search(percent), "a long, b long")


def _check_heads(percent: int):
    """Links of a head with the other sets of its group that overlap enough."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for head, rows in part.groupby("head", sort=False):
            mine = rows["node"].to_numpy() == head
            if not mine.any():
                continue
            base = np.asarray(rows["shingles"].to_numpy()[mine][0]).view(np.uint64)
            for node, values in zip(rows["node"].to_numpy()[~mine], rows["shingles"].to_numpy()[~mine]):
                values = np.asarray(values).view(np.uint64)
                if _overlap(base, values) * (100 + percent) >= percent * (len(base) + len(values)):
                    out.append((head, node))
        return pd.DataFrame({"a": [a for a, _ in out], "b": [b for _, b in out]}, dtype="int64")
    return run


def _head_links(whole: DataFrame, heads: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Exact links of each set with its head, (node, head); a head's set goes to each block of its sets."""
    crowd = scratch.keep(heads.groupBy("head").agg(F.count(F.lit(1)).alias("held")))
    total = heads.count()
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / LEAF_POINTS)).cast("long")
    asked = attach_groups(heads, crowd, ["head"], "held", total).select("node", "head", block.alias("block"))
    blocks = crowd.select(F.col("head").alias("node"), "head", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("held") / LEAF_POINTS) - 1)).alias("block"))
    placed = whole.select("node", "shingles").join(asked.unionByName(blocks), "node")
    return placed.groupBy("head", "block").applyInPandas(_check_heads(percent), "a long, b long")


def _component_of(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of their node, which is the node itself without a link."""
    return rows.join(found, "node", "left").withColumn(name, F.coalesce("component", "node")).drop("component")


def _stars(found: DataFrame) -> DataFrame:
    """(a, b): each node and its component, which connect as much as the links they come from."""
    return found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _links(docs: DataFrame, prints: DataFrame, classes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) document ids that connect every pair at the threshold, over one row per set.

    The bounds of the points connect each set with the first of its runs of equal keys; runs
    that this leaves in several components are then searched for pairs across them. With the sets in hand the
    same is done exactly: each set is checked against its nearest heads, and what that connects is
    compared only with what it does not connect. So a large group of near copies costs
    about one comparison a member.
    """
    key = ["n_shingles", "one", "two"]
    keyed = scratch.keep(
        docs.select("text").mapInArrow(_keys(words, percent), "key long, node long")
        .repartition("key").sortWithinPartitions("key", "node")
        .mapInArrow(_run_links, "key long, a long, b long")
    )
    runs = scratch.keep(keyed.select("a", "b").distinct())
    sharing = runs.select(F.explode(F.array("a", "b")).alias("one")).distinct()
    chosen = classes.join(sharing, "one").select(*key, F.col("least_id").alias("doc_id"))
    points = scratch.keep(
        prints.join(chosen, ["doc_id", *key]).dropDuplicates(["doc_id", *key])
        .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "point", "parity",
                F.col("one").alias("print_a"), F.col("two").alias("print_b"))
    )
    near = scratch.keep(_near_heads(runs, points, percent, scratch))
    joined = components(near.select(F.col("node").alias("a"), F.col("head").alias("b")))
    members = _run_members(keyed, points, scratch)
    tried = scratch.keep(_subtrees(members, joined, scratch).join(points.drop("print_a", "print_b"), "node"))
    # What the bounds connect; only its sets are needed.
    found = _search_tree(tried, percent, scratch)
    parts = scratch.keep(
        components(found.unionByName(_stars(joined))).select("node", F.col("component").alias("part"))
    )
    wanted = docs.sparkSession.sparkContext.broadcast(_id_filter(parts))
    sets = (
        docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
        .mapInArrow(_sets(words, wanted), "node long, print_a long, print_b long, shingles array<long>")
    )
    placed = points.join(parts, "node").withColumnRenamed("part", "subtree")
    # Copies of a row share all of these; the join drops what only the filter let through.
    whole = scratch.keep(sets.join(placed, ["node", "print_a", "print_b"]).dropDuplicates(["node"]))
    # A node has no more heads than keys.
    best = F.slice(F.sort_array(F.collect_set(F.struct("share", "head")), asc=False), 1, HEADS)
    heads = scratch.keep(near.groupBy("node").agg(best.alias("best")).select("node", F.explode("best.head").alias("head")))
    checked = components(_head_links(whole, heads, percent, scratch))
    compared = scratch.keep(_component_of(whole, checked, "known"))
    return _search_tree(compared, percent, scratch).unionByName(_stars(checked))


def _run_members(keyed: DataFrame, points: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node) of the runs to search; runs of the same sets, of which near copies have many, are one.

    A run of two is its head and a set checked against it, so nothing is left to compare.
    """
    hashes = [F.bit_xor(F.xxhash64("a")).alias("one"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("two")]
    whole = keyed.groupBy("key").agg(F.min("b").alias("head"), F.count(F.lit(1)).alias("held"), *hashes).where("held > 1")
    once = scratch.keep(whole.groupBy("head", "held", "one", "two").agg(F.min("key").alias("key")).select("key", "head", "held"))
    others = attach_groups(keyed.select("key", F.col("a").alias("print_a")), once.select("key", "held"), ["key"], "held", keyed.count())
    members = others.select("key", "print_a").unionByName(once.select("key", F.col("head").alias("print_a")))
    return members.join(points.select("print_a", "node"), "print_a").select("key", "node").distinct()


def _subtrees(members: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """(subtree, node, known) of the runs with sets of several components, in which all that is left to link is.

    A subtree is a run, or what such runs connect, if that has fewer pairs than its runs have together.
    """
    count = F.count(F.lit(1))
    named = scratch.keep(_component_of(members, joined, "known"))
    several = named.groupBy("key").agg(count.alias("held"), F.min("known").alias("least"), F.max("known").alias("most"))
    several = scratch.keep(several.where("least < most").drop("most"))
    left = scratch.keep(attach_groups(named, several, ["key"], "held", named.count()))
    nodes = scratch.keep(left.groupBy("node", "known").agg(count.alias("runs"), F.sum("held").alias("pairs")))
    # One row per component of linked sets, and what the runs connect these to.
    parts = nodes.groupBy("known").agg(count.alias("nodes"), F.sum("runs").alias("rows"), F.sum("pairs").alias("pairs"))
    whole = components(left.select(F.col("known").alias("a"), F.col("least").alias("b")))
    parts = scratch.keep(parts.join(whole.withColumnRenamed("node", "known"), "known"))
    trees = scratch.keep(
        parts.groupBy("component").agg(count.alias("held"), (F.sum("nodes").cast("double") * F.sum("nodes") <= F.sum("pairs")).alias("merged"))
    )
    parts = scratch.keep(attach_groups(parts, trees, ["component"], "held", parts.count()))
    merged = parts.where("merged").select("known", "component", "nodes")
    apart = parts.where("NOT merged").select("known", "rows")
    out = ["subtree", "node", "known"]
    return (
        attach_groups(nodes, merged, ["known"], "nodes", nodes.count()).withColumnRenamed("component", "subtree").select(*out)
        .unionByName(attach_groups(left, apart, ["known"], "rows", left.count()).withColumnRenamed("key", "subtree").select(*out))
    )


def _check_parities(percent: int):
    """(node, head, share) of the pairs whose parities allow a link."""
    def run(batches):
        for batch in batches:
            node, head, n, other = (np.asarray(batch.column(c)) for c in ("node", "head", "n", "n_2"))
            mine, theirs = batch.column("parity").to_pylist(), batch.column("parity_2").to_pylist()
            apart = np.zeros(len(n), np.int64)
            alike: dict[tuple[int, int], list[int]] = {}
            for k, (x, y) in enumerate(zip(mine, theirs, strict=True)):
                alike.setdefault((len(x), len(y)), []).append(k)
            for at in alike.values():
                apart[at] = _differing(_rows_of([mine[k] for k in at]), _rows_of([theirs[k] for k in at]))
            fits = apart * (100 + percent) <= (100 - percent) * (n + other)
            share = (n + other - apart) / (n + other + apart)
            yield pa.RecordBatch.from_arrays([pa.array(x[fits]) for x in (node, head, share)], ["node", "head", "share"])
    return run


def _near_heads(runs: DataFrame, points: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, head, share) for the runs' links that the bounds of points and parities allow.

    ``share`` is the parities' bound of the similarity. Links are by print, of which a few ids may share
    one; heads with many links are sent to them by broadcast.
    """
    sides = points.select("node", "n", "point", "parity", "print_a")
    total = runs.count()
    crowd = runs.groupBy("b").agg(F.sum(F.lit(1)).alias("held"))
    heads = scratch.keep(crowd.join(sides.withColumnRenamed("print_a", "b"), "b").select(
        "b", "held", F.col("node").alias("head"), F.col("n").alias("n_2"), F.col("point").alias("point_2"), F.col("parity").alias("parity_2")
    ))
    asked = runs.select("a", "b").join(sides.withColumnRenamed("print_a", "a"), "a")
    met = attach_groups(asked, heads, ["b"], "held", total).where("node <> head")
    allowed = met.where(_bound(_minima("point", "point_2"), F.col("n"), F.col("n_2"), percent))
    return (
        allowed.select("node", "head", "n", "n_2", "parity", "parity_2")
        .mapInArrow(_check_parities(percent), "node long, head long, share double")
        .groupBy("node", "head").agg(F.max("share").alias("share"))
    )


def ngram_jaccard_join(
    docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, by links of Jaccard >= percent / 100.

    Words are runs without ASCII white space, A-Z in lower case; a set holds the distinct
    shingles of ``words`` words, a shorter text is one shingle. Null and blank texts have no
    shingle and link with nothing. Rows with a null id link with nothing either; rows that
    share an id share its links. Other columns are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scratch = Scratch()
    prints = materialise(
        docs.mapInArrow(_prints(words), "doc_id long, n_shingles long, one long, two long, point array<int>, parity binary")
    )
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    key = ["n_shingles", "one", "two"]
    rows = prints.where(usable).drop("point", "parity")
    classes = materialise(rows.groupBy(*key).agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")))
    links = _links(docs.where("doc_id IS NOT NULL"), prints.where(usable), classes, words, percent, scratch)
    # Rows that share an id but not a text connect their classes.
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    shared = (
        rows.join(again, "doc_id").join(classes, key)
        .select(F.col("doc_id").alias("a"), F.col("least_id").alias("b"))
    )
    found = components(links.unionByName(shared))
    named = materialise(
        classes.join(found.withColumnRenamed("node", "least_id"), "least_id", "left")
        .select(*key, "copies", F.coalesce("component", "least_id").alias("component_id"))
    )
    scratch.clear()
    total = prints.count()
    out = ["doc_id", "n_shingles", "component_id"]
    return attach_groups(rows, named, key, "copies", total).select(*out).unionByName(
        prints.where(~usable).withColumn("component_id", F.col("doc_id")).select(*out)
    )


def drop_near_copies(
    docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each group of near copies, with all columns: the one with the smallest id.

    Rows that share an id are told apart by their text, so each text is compared and kept or
    dropped on its own; of rows equal in id and text one stays. Rows with a null id stay.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("shared_id")).where("shared_id IS NOT NULL")
    several = materialise(ids.groupBy("shared_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("shared_id"))
    if not several.limit(1).count():
        found = ngram_jaccard_join(docs, words, percent, id_col, text_col)
        lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias("lost_id")).distinct()
        return docs.join(lost, F.col(id_col).cast("long") == lost["lost_id"], "left_anti").select(*docs.columns)
    own = F.col(id_col).cast("long")
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    odd = docs.join(several, own == several["shared_id"], "left_semi").withColumn("__sha", sha)
    # A node of its own, below all ids, for each text of a repeated id; the checkpoint fixes it.
    texts = materialise(odd.select(own.alias("id"), "__sha").distinct().withColumn("below", F.monotonically_increasing_id()))
    floor = F.lit(min(ids.agg(F.min("shared_id")).first()[0], 0) - 1)
    texts = texts.select("id", "__sha", (floor - F.col("below")).alias("__node"))
    odd = odd.join(texts.withColumnRenamed("__sha", "sha"), (own == F.col("id")) & (F.col("__sha") == F.col("sha")))
    odd = odd.select(*[F.col(f"`{c}`") for c in docs.columns], "__node")
    plain = docs.join(several, own == several["shared_id"], "left_anti")
    both = plain.select(own.alias("__node"), F.col(text_col).alias("text")).unionByName(odd.select("__node", F.col(text_col).alias("text")))
    found = materialise(ngram_jaccard_join(both, words, percent, "__node", "text").where("doc_id IS NOT NULL").distinct())
    named = found.join(texts.select(F.col("__node").alias("doc_id"), "id", "__sha"), "doc_id", "left")
    named = named.withColumn("place", F.struct(F.coalesce("id", "doc_id").alias("id"), F.coalesce("__sha", F.lit("")).alias("sha")))
    groups = materialise(
        named.groupBy("component_id").agg(F.min_by("doc_id", "place").alias("kept_node"), F.count(F.lit(1)).alias("size"))
        .where("size > 1")
    )
    lost = attach_groups(found, groups, ["component_id"], "size", found.count()).where("doc_id <> kept_node")
    lost = materialise(lost.select(F.col("doc_id").alias("lost_id")))
    plain = plain.join(lost, own == lost["lost_id"], "left_anti").select(*docs.columns)
    odd = odd.join(lost, odd["__node"] == lost["lost_id"], "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return plain.unionByName(odd.groupBy("__node").agg(F.first(whole).alias("__row")).select("__row.*"))

"""Connected components, and groups handed back to their rows, without a hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.session import Stored, store


class Scratch:
    """Written intermediate tables; ``clear`` removes those that no result reads any more."""

    def __init__(self):
        self._held: list[Stored] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows from a written table of their own."""
        self._held.append(store(df))
        return self._held[-1].table

    def clear(self) -> None:
        for held in self._held:
            held.drop()
        self._held.clear()

#: A key that holds at least 1 / HOT_SHARE of all rows is joined by broadcast; there can be
#: no more than HOT_SHARE such keys, whatever the data.
HOT_SHARE = 1000


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key, where ``size`` counts the rows of a key.

    Keys with a large share of the rows go by broadcast (at most HOT_SHARE of them), the
    rest by an ordinary join in which no key has more than 1 / HOT_SHARE of the rows. Without
    such keys, for which ``groups`` is read once at once, the ordinary join is all.
    """
    hot = groups.where(F.col(size) * HOT_SHARE >= total).where(F.col(size) > HOT_SHARE)
    if not hot.agg(F.count(F.lit(1))).first()[0]:
        return rows.join(groups, keys)
    few = F.broadcast(hot)
    cold = groups.where((F.col(size) * HOT_SHARE < total) | (F.col(size) <= HOT_SHARE))
    joined_hot = rows.join(few, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return joined_hot.unionByName(rest.join(cold, keys))


def _ends(edges: DataFrame, one: list[Column], other: list[Column]) -> DataFrame:
    """Two rows per edge from one scan."""
    return edges.select(F.inline(F.array(F.struct(*one), F.struct(*other))))


def _flat(edges: DataFrame) -> bool:
    """Has every node at most one smaller neighbour, which has none itself?"""
    yes, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = _ends(
        edges, [F.col("u").alias("node"), yes.alias("up"), no.alias("down")],
        [F.col("v").alias("node"), no.alias("up"), yes.alias("down")],
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1 AND up > 0").agg(F.count(F.lit(1))).first()[0] == 0


def _least(edges: DataFrame, bound: Column) -> DataFrame:
    return edges.groupBy("u").agg(F.min(bound).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours move to the least neighbour (or the node itself)."""
    both = _ends(edges, [F.col("u"), F.col("v")], [F.col("v").alias("u"), F.col("u").alias("v")])
    met = both.join(_least(both, F.least("u", "v")), "u").where("v > u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node, move to the least of them."""
    met = edges.join(_least(edges, F.col("v")), "u")
    moved = _ends(met, [F.col("u"), F.col("m").alias("v")], [F.col("v").alias("u"), F.col("m").alias("v")])
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node.

    ``edges`` has two long columns a and b. Alternates large-star and small-star steps until
    each node points at the smallest of its component, which costs nothing if it does at once.
    A step is one join over a written table, so a lost executor costs one step and plans stay
    small (the driver holds what is left of every plan); the table before it is removed.
    """
    held = store(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )
    while not _flat(held.table):
        for step in (_large_star, _small_star):
            after = store(step(held.table))
            held.drop()
            held = after
    edges = held.table
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

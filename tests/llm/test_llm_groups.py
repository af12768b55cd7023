"""Components and group joins: results, and plans small enough to leave little in the driver."""

import random

import pytest

from tabulon.llm import groups
from tests_llm_helpers import closed


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


@pytest.fixture
def written(monkeypatch):
    """Joins of each table that components writes."""
    seen, store = [], groups.store

    def counted(df):
        seen.append(joins(df))
        return store(df)

    monkeypatch.setattr(groups, "store", counted)
    return seen


def check(spark, edges):
    got = {r.node: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == closed(sorted({x for a, b in edges if a != b for x in (a, b)}), [(a, b) for a, b in edges if a != b])


@pytest.mark.parametrize("edges", [[], [(4, 4)], [(1, 9), (9, 1), (1, 5), (-2, 3), (7, 7)]])
def test_stars_take_no_step(spark, written, edges):
    check(spark, edges)
    assert written == [0]


def test_components_by_one_join_a_step(spark, written):
    places = random.Random(5).sample(range(-60, 60), 40)
    chain = list(zip(places, places[1:], strict=False))
    hub = [(500, 100 + i) for i in range(80)]  # the largest node holds all others
    check(spark, chain + hub)
    assert len(written) > 2 and max(written) == 1


@pytest.mark.parametrize("copies, total, hot", [(1500, 1600, True), (900, 1000, False)])
def test_attach_groups_without_hot_keys_is_one_join(spark, copies, total, hot):
    want = [(i, 0 if i < copies else i, copies if i < copies else 1) for i in range(total)]
    rows = spark.createDataFrame([(i, g) for i, g, _ in want], "id long, g long")
    sizes = rows.groupBy("g").count().withColumnRenamed("count", "size")
    out = groups.attach_groups(rows, sizes, ["g"], "size", total)
    assert sorted((r.id, r.g, r["size"]) for r in out.collect()) == want
    assert hot == (joins(out) > 1)

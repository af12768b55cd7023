"""How filters interact: what each order of them removes, and each one's fair share.

Removing is a cooperative game: the worth of a coalition of filters is the number of
documents that at least one of them would remove. Documents are first counted by the set of
filters they fail, so everything after works on at most 32 counts per part of the corpus.

* The potential of a coalition is P(S) = (worth(S) + sum of P(S without i) over i in S) / |S|,
  with P of the empty one 0. A filter's Shapley value is P(all) - P(all without it). Potentials
  are kept 60-fold, where they are whole numbers, as every size up to five divides 60.
* A step of an order removes worth(filters so far) - worth(filters before).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
_SCALE = 60
_SPACES = r"\x20\x09-\x0D"
_COUNTS = ("n", "good", "toxic")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; null counts as empty.

    A: under 100 words. B: under 80 % distinct words. C: over 10 % capitals A-Z. D: a sign of
    ``#$%&*|``.
    """
    held = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(held, f"[{_SPACES}]+"), lambda w: w != "")

    def of_words(w):
        few = F.when(F.size(w) < 100, 1).otherwise(0)
        return few + F.when(F.size(F.array_distinct(w)) * 100 < F.size(w) * 80, 2).otherwise(0)

    capitals = F.length(held) - F.length(F.translate(held, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (
        _let(words, of_words)
        + F.when(capitals * 100 > F.length(held) * 10, 4).otherwise(0)
        + F.when(held.rlike(r"[#$%&*|]"), 8).otherwise(0)
    )


def flag_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, fails, n): how many rows with this id fail these filters, as bits A = 1 to E = 16.

    E: the text equals that of a smaller id anywhere in the table. A row without an id is
    not larger than any, so it never fails E, and makes no other row fail; rows that repeat
    both id and text all pass it. A null part is the empty string. Texts meet as two hashes
    of 64 bits, with one row per text and id.
    """
    held = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(held).alias("h1"), F.xxhash64(F.lit(1), F.octet_length(held), held).alias("h2"),
        own_failures(F.col(f"`{text}`")).alias("own"),
    ).groupBy("doc_id", "part", "h1", "h2", "own").agg(F.count(F.lit(1)).alias("n"))
    least = rows.where("doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    # (id, text) is all but unique, so that a text with a third of all rows is no hot key.
    first = rows.join(least.withColumn("first", F.lit(True)), ["doc_id", "h1", "h2"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return first.select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("fails"), "n")


def _worths(counts: str) -> Column:
    """Per coalition, the rows that fail one of its filters; ``counts`` has a number per set of failed filters."""
    def worth(coalition):
        hit = F.filter(counts, lambda _, fails: fails.bitwiseAND(coalition) != 0)
        return F.aggregate(hit, F.lit(0).cast("long"), lambda total, c: total + c)

    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), worth)


def coalition_table(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part: its size, and per coalition the worth in rows, good and toxic rows, and the potential.

    ``labels`` has doc_id, quality and toxic; several rows of an id count as one that says
    1 if any does. Columns: part, total, ``worth``, ``worth_good``, ``worth_toxic``,
    ``potential`` (arrays over the 32 coalitions, by their bits).
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    n = F.col("n")
    cells = flagged.join(marks, "doc_id", "left").groupBy("part", "fails").agg(
        F.sum(n).alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    by_fails = [
        F.array(*[F.coalesce(F.sum(F.when(F.col("fails") == f, F.col(c))), F.lit(0)).cast("long") for f in range(ALL + 1)]).alias(c)
        for c in _COUNTS
    ]
    counts = cells.groupBy("part").agg(F.sum("n").alias("total"), *by_fails)
    worths = counts.select(
        "part", "total", _worths("n").alias("worth"), _worths("good").alias("worth_good"), _worths("toxic").alias("worth_toxic")
    )
    # A projection per coalition size: each needs the potentials of the size below.
    table, name = worths, ["CAST(0 AS BIGINT)", *[f"p{s}" for s in range(1, ALL + 1)]]
    for size in range(1, len(FILTERS) + 1):
        made = {}
        for s in range(1, ALL + 1):
            if s.bit_count() == size:
                smaller = " + ".join(name[s & ~(1 << i)] for i in range(len(FILTERS)) if s >> i & 1)
                made[name[s]] = F.expr(f"(worth[{s}] * {_SCALE} + {smaller}) div {size}")
        table = table.withColumns(made)
    return table.select("part", "total", "worth", "worth_good", "worth_toxic", F.array(*[F.expr(p) for p in name]).alias("potential"))


def audit_filters(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; see the module's text.

    ``kept``: rows left after the step; ``removed``: rows it takes; ``redundant``: rows that
    fail its filter and went before; ``unique_fails``: rows that fail its filter alone;
    ``good_lost``/``toxic_lost``: labelled rows it takes; ``shapley``: what its filter
    removes in all orders together. An empty table has no part and gives no row.
    """
    steps = []
    for order in permutations(FILTERS):
        for k, letter in enumerate(order):
            before = sum(1 << FILTERS.index(f) for f in order[:k])
            steps.append((F.lit("".join(order)), F.lit(k + 1), F.lit(1 << FILTERS.index(letter)), F.lit(before)))
    listed = F.array(*[F.struct(o.alias("filter_order"), k.alias("step"), i.alias("bit"), b.alias("before")) for o, k, i, b in steps])
    table = coalition_table(flagged, labels).select("*", F.inline(listed))
    after, others = F.col("before").bitwiseOR(F.col("bit")), F.lit(ALL).bitwiseXOR(F.col("bit"))

    def taken(worth):
        return F.get(worth, after) - F.get(worth, F.col("before"))

    return table.select(
        "part", "filter_order", "step", (F.col("total") - F.get("worth", after)).alias("kept"), taken(F.col("worth")).alias("removed"),
        (F.get("worth", F.col("bit")) - taken(F.col("worth"))).alias("redundant"),
        (F.get("worth", F.lit(ALL)) - F.get("worth", others)).alias("unique_fails"),
        taken(F.col("worth_good")).alias("good_lost"), taken(F.col("worth_toxic")).alias("toxic_lost"),
        # 5! orders times the Shapley value; the potentials are 60-fold
        ((F.get("potential", F.lit(ALL)) - F.get("potential", others)) * (120 // _SCALE)).alias("shapley"),
    )


#: The same in SQL: worths of coalitions from the rows, removals of every order and step.
ORACLE = """
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS words,
        min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    f AS (SELECT w.doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
        (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN w.doc_id > least THEN 16 ELSE 0 END) AS fails
        FROM w LEFT JOIN labels ON w.doc_id = labels.doc_id),
    c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
    i AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
    o AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM i a, i b, i c, i d, i e
        WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND a.i <> e.i AND b.i <> c.i AND b.i <> d.i AND b.i <> e.i
        AND c.i <> d.i AND c.i <> e.i AND d.i <> e.i),
    s AS (SELECT 'ABCDE'[a + 1] || 'ABCDE'[b + 1] || 'ABCDE'[c + 1] || 'ABCDE'[d + 1] || 'ABCDE'[e + 1] AS filter_order,
        k.i + 1 AS step, 1 << [a, b, c, d, e][k.i + 1] AS bit,
        list_sum([1 << x FOR x IN [a, b, c, d, e][1:k.i]]) AS bits FROM o, i k),
    steps AS (SELECT filter_order, step, bit, coalesce(bits, 0)::INTEGER AS before FROM s),
    r AS (SELECT part, filter_order, step, bit,
        sum(n) FILTER (WHERE fails & (before | bit) = 0) AS kept,
        sum(n) FILTER (WHERE fails & bit <> 0 AND fails & before = 0) AS removed,
        sum(n) FILTER (WHERE fails & bit <> 0 AND fails & before <> 0) AS redundant,
        sum(n) FILTER (WHERE fails = bit) AS unique_fails,
        sum(good) FILTER (WHERE fails & bit <> 0 AND fails & before = 0) AS good_lost,
        sum(toxic) FILTER (WHERE fails & bit <> 0 AND fails & before = 0) AS toxic_lost
        FROM c, steps GROUP BY ALL)
    SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
        coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
        coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
        sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""

"""Order MinHash against a plain version that sorts the k-mers anew for every slot."""

import bisect
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tabulon.llm import order_minhash as om
from tabulon.llm import queries

DOCS = "doc_id long, text string"


def chained(values):
    """Spark's xxhash64 of several strings or whole numbers (8 bytes, 4 for an int32 pair)."""
    seed = 42
    for v in values:
        data = v if isinstance(v, bytes) else v.encode()
        seed = xxhash.xxh64(data, seed=seed & (2**64 - 1)).intdigest()
    return seed


def long8(x):
    return (x & (2**64 - 1)).to_bytes(8, "little")


def brute(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")
    n = max(len(tokens) - 1, min(len(tokens), 1))
    kmers = [chained(tokens[i : i + 2]) for i in range(n)]
    seen, points = {}, []
    for place, h in enumerate(kmers):
        cut = h & (2**33 - 1)
        occurrence = seen[cut] = seen.get(cut, -1) + 1
        points.append((chained([long8(cut), occurrence.to_bytes(4, "little")]) & (2**33 - 1), place))
    slots = []
    for j in range(om.SLOTS if points else 0):
        begin = j * (2**33 // om.SLOTS)
        by_slot = sorted(points, key=lambda p: ((p[0] - begin) % 2**33, p[1]))
        least = [by_slot[t % len(by_slot)][1] for t in range(om.TUPLE)]
        slots.append(chained([long8(kmers[p]) for p in sorted(least)]) & 65535)
    return slots


def texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "extraordinarily", "é", "日本語テキスト処理技術", "x"]
    made = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 8, 40, 400)]
    return [*made, "", None, " \t\n", "ab" * 5_000, "one two three four", "a a a a a a a"]


def test_slots_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = spark.createDataFrame(rows, DOCS).select("doc_id", om.order_minhash(F.col("text")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: brute(t) for i, t in rows}


def test_order_counts(spark):
    words = [f"w{i}" for i in range(60)]
    moved = words[30:] + words[:30]
    rows = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(words[:-1] + ["z"]))], "a string, b string, c string")
    slots = rows.select(*[om.order_minhash(F.col(c)).alias(c) for c in "abc"])
    near = slots.select(om.likeness(F.col("a"), F.col("b")).alias("ab"), om.likeness(F.col("a"), F.col("c")).alias("ac")).first()
    # all but one k-mer are shared after the move, yet pairs across the cut changed their order
    assert near["ac"] > 0.85 and near["ab"] < 0.8


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out = {}
    for k, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = brute(text), brute(edited), brute(following)

        def alike(x, y):
            return 0.0 if len(x) != len(y) else sum(i == j for i, j in zip(x, y)) / len(x) if x else 1.0

        written = ["".join(f"{s:04x}" for s in x) for x in (a, b)]
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *written, alike(a, b), alike(a, c))
    return out


def result(df):
    names = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return {r["doc_id"]: tuple(r[c] for c in names) for r in df.collect()}


@pytest.mark.parametrize("bytes_a_range", [1, 4_000, 8 << 20])
def test_edits_and_next_documents(spark, monkeypatch, tmp_path, bytes_a_range):
    monkeypatch.setattr(om, "RANGE_BYTES", bytes_a_range)
    rows = [(7 * i - 20, t) for i, t in enumerate(texts())] + [(None, "no id here")]
    spark.createDataFrame([(*r, 0, "x") for r in rows], DOCS + ", key int, tie string").write.parquet(f"{tmp_path}/documents.parquet")
    assert result(queries.op13_order_minhash(spark, str(tmp_path))) == expected(rows)


def test_repeated_ids_meet_once_each(spark, monkeypatch):
    monkeypatch.setattr(om, "RANGE_BYTES", 1)
    rows = [(5, f"text number {i}") for i in range(40)] + [(5, "text number 1"), (1, "first"), (9, "last")]
    made = om.fingerprint_edits(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in made) == sorted(rows)
    # the next ones are a walk through all rows: each row's start is used once
    heads = sorted(r["edited"][len(r["text"]) - len(r["text"]) // 2 :] for r in made)
    assert len(heads) == len(rows)
    assert next(r["edited"] for r in made if r["doc_id"] == 9) == "lafi"


def test_single_and_no_documents(spark):
    one = om.fingerprint_edits(spark.createDataFrame([(1, "abcdef")], DOCS)).first()
    assert one["edited"] == "abcabc"
    assert om.fingerprint_edits(spark.createDataFrame([], DOCS)).collect() == []


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op13_order_minhash(spark, folder)) == expected(rows)


def test_many_ranges_need_a_small_expression(spark):
    """As many ranges as 6 GB has: the cuts are in the plan once, not once per path of the halving."""
    cuts = [*range(-7, 2200, 3)]
    found = spark.range(-20, 2300).select("id", om._count_up_to(F.col("id"), cuts).alias("n"))
    assert len(found._jdf.queryExecution().analyzed().toString()) < 20_000
    assert all(r["n"] == bisect.bisect_right(cuts, r["id"]) for r in found.collect())
    doubles = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (-1.0,)], "x double")
    assert [r[0] for r in doubles.select(om._count_up_to(F.col("x"), [-1.0, 0.5, 2.0])).collect()] == [0, 3, 2, 1]

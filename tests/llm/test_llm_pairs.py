"""Near-duplicate joins and exact dedup against brute force."""

import math
import random

import numpy as np
import pytest

from tabulon.llm import embedding_dedup, ngram_join
from tabulon.llm.digest_index import DigestIndex, buckets_for, deduplicate, drop_copies
from tabulon.llm.embedding_dedup import embedding_near_dedup
from tabulon.llm.groups import components
from tabulon.llm.ngram_join import Bands, group_keys, ngram_jaccard_join
from tests_llm_helpers import closed, shingles

DOCS = "doc_id long, text string, lang string, one string, component long"


def near_texts(seed=3, families=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "İx", "ABC"]
    out = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([2, 3, 8, 12, 14, 40, 120, 400]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy[: rng.choice([None, None, -1, -2]) or len(copy)]))
    return out + [None, "", " \t\n", "alone", "alone", "ALONE", "two words", "word " * 3000]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 60)])
def test_ngram_join_equals_brute_force(spark, k, percent):
    texts = near_texts(k)
    rows = [(i * 7 % 1009, t, None, "x", 5) for i, t in enumerate(texts)]
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    ids = list(sets)
    linked = [
        (a, b) for n, a in enumerate(ids) for b in ids[:n]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = closed(ids, linked)
    got = ngram_jaccard_join(spark.createDataFrame(rows, DOCS), k, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), want[i]) for i, s in sets.items()}
    assert len(got) == len(rows)


def test_ngram_join_of_odd_tables(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d", None, None, 1), (4, "a b c d", None, None, 1), (4, "a b c d", None, None, 1), (2, None, None, None, 1)]
    got = sorted(ngram_jaccard_join(spark.createDataFrame(rows, DOCS)).collect(), key=str)
    assert [tuple(r) for r in got] == [(2, 0, 2), (4, 2, 4), (4, 2, 4), (None, 2, None)]


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90):
        bands = Bands(percent)
        for n in [4, 9, 10, 12, 19, 20, 33, 100, 777]:
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for _ in range(40):
                drop, add = rng.integers(0, n // 4 + 1), rng.integers(0, n // 4 + 1)
                b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
                both = len(np.intersect1d(a, b))
                if len(b) and len(a) + len(b) > 2 * both and 100 * both >= percent * (len(a) + len(b) - both):
                    assert np.intersect1d(group_keys(a, bands), group_keys(b, bands)).size


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for family in range(30):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 7))):
            v = base + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2, 0.3])
            rows.append((len(rows) * 3, [float(np.float32(x)) for x in v], int(family % 3)))
    n = len(rows) * 3
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, [2 * x for x in rows[0][1]], rows[0][2]), (n + 2, rows[0][1], None)]
    rows += [(n + 3, None, 1), (n + 4, [0.0] * 16, 1), (n + 5, [1.0] * 15 + [float("nan")], 1), (n + 6, [1.0] * 15 + [float("inf")], 1)]
    return rows + [(n + 7, [1.0, None], 1), (n + 8, [], 1), (n + 9, [1.0, 2.0], 1), (n + 10, [2.0, 4.0], 1)]


def test_embeddings_equal_brute_force(spark):
    rows = vectors()
    sound = {i: (np.array(v, float), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    linked = [
        (a, b) for a in sound for b in sound
        if a != b and sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0])
        and sound[a][0] @ sound[b][0] / (np.linalg.norm(sound[a][0]) * np.linalg.norm(sound[b][0])) >= 0.93
    ]
    want = closed([i for i, *_ in rows], linked)
    got = embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {
        (i, sum(a == i for a, _ in linked), want[i], want[i] == i) for i, *_ in rows
    }
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_near_dedup(none).collect() == []


def test_embedding_recall(spark):
    """At least 0.99 of all links of the small table are found."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    e = np.array([r.embedding for r in rows], float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    links = ((e @ e.T >= 0.93) & (label[:, None] == label)).sum() - len(rows)
    found = sum(r.n_links for r in embedding_near_dedup(table).collect())
    assert links * 0.99 <= found <= links


@pytest.mark.parametrize("cells", [64, 512])
def test_embedding_recall_of_planted_pairs(spark, monkeypatch, cells):
    """At least 0.99 of pairs planted just above the threshold are found, whatever the number of lists."""
    monkeypatch.setattr(embedding_dedup, "CELLS", (cells, 4096))
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.95, size=(1500, 1))
    every = np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * aside)) * rng.uniform(0.5, 2, size=(3000, 1))
    units = every / np.linalg.norm(every, axis=1, keepdims=True)
    links = int((units @ units.T >= 0.93).sum()) - len(every)
    assert links >= 2990
    # Doubles, and labels that are no numbers.
    rows = spark.createDataFrame([(i, v.tolist(), "one label") for i, v in enumerate(every)], "vec_id long, embedding array<double>, label string")
    found = sum(r.n_links for r in embedding_near_dedup(rows).collect())
    assert links * 0.99 <= found <= links


def test_embeddings_are_compared_in_double_precision(spark):
    """Pairs nearer to the threshold than a float can tell."""
    rows = []
    for k, cosine in enumerate((0.93 + 1e-12, 0.93 - 1e-12)):
        rows += [(2 * k, [1.0, 0.0], 2**40 + k), (2 * k + 1, [cosine, math.sqrt(1 - cosine * cosine)], 2**40 + k)]
    got = embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    assert {r.vec_id: r.n_links for r in got} == {0: 1, 1: 1, 2: 0, 3: 0}


@pytest.fixture
def index(spark):
    made = DigestIndex(spark, "digests_test", buckets=4)
    made.drop()
    yield made
    made.drop()


def test_digest_index_over_two_batches(spark, index):
    first = [(3, "a b", "en", "x", 1), (1, "ab", None, "x", 1), (2, "a\tb ", None, None, 1), (9, None, None, None, 1), (8, " \n", None, None, 1), (5, "a b", None, None, 1)]
    got = {r.doc_id: r for r in deduplicate(spark.createDataFrame(first, DOCS), index).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {
        3: (2, 3, False), 1: (2, 3, False), 2: (2, 3, True), 9: (8, 2, False), 8: (8, 2, True), 5: (5, 1, True)
    }
    second = [(20, "a  b", None, None, 1), (21, "new", None, None, 1), (22, "n e w", None, None, 1)]
    got = {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(spark.createDataFrame(second, DOCS), index).collect()}
    assert got == {20: (2, False), 21: (22, False), 22: (22, True)}
    assert index.read().count() == 4
    assert deduplicate(spark.createDataFrame([], DOCS), index).collect() == []


def test_drop_copies_keeps_one_row_of_each_text(spark, index):
    rows = [(1, "a", "en", "x", 1), (1, "a", "en", "x", 1), (1, "b", "de", "x", 1), (None, "c", None, None, 1), (None, "c", None, None, 1), (2, "b ", None, None, 2), (3, "d", None, None, None)]
    kept = drop_copies(spark.createDataFrame(rows, DOCS), index)
    assert kept.columns == ["doc_id", "text", "lang", "one", "component"]
    assert sorted((r.text, r.doc_id) for r in kept.collect()) == [("a", 1), ("b ", 2), ("c", None), ("d", 3)]


def test_first_batch_goes_through_the_index(spark, index, monkeypatch):
    read, seen = DigestIndex.read, []
    monkeypatch.setattr(DigestIndex, "read", lambda self: seen.append(read(self).count()) or read(self))
    append = DigestIndex.append
    # What the index holds, not what the batch says, must come out.
    monkeypatch.setattr(DigestIndex, "append", lambda self, rows: append(self, rows.withColumn("keep_id", rows["keep_id"] + 100)))
    rows = [(1, "a", None, None, 1), (2, "a", None, None, 1), (3, "b", None, None, 1)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in deduplicate(spark.createDataFrame(rows, DOCS), index).collect()}
    assert got == {1: (101, 2), 2: (101, 2), 3: (103, 1)}
    assert seen == [0, 2]


def test_index_knows_texts_of_nameless_rows(spark, index):
    deduplicate(spark.createDataFrame([(None, "z", None, None, 1)], DOCS), index)
    got = deduplicate(spark.createDataFrame([(7, "z", None, None, 1)], DOCS), index).collect()
    assert [(r.keep_id, r.kept) for r in got] == [(None, False)]


def test_a_large_group_of_near_copies_costs_in_proportion(spark, monkeypatch):
    """Leaves of one component never meet; only sets outside it are sent to them."""
    monkeypatch.setattr(ngram_join, "LEAF_POINTS", 32)
    placed, original = [], ngram_join._search_tree

    def watched(points, percent, scratch):
        out = original(points, percent, scratch)
        placed.append(scratch._held[-1].table.selectExpr("coalesce(sum(held), 0)").first()[0])
        return out

    monkeypatch.setattr(ngram_join, "_search_tree", watched)
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    rows = []
    for i in range(900):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(120)] = f"z{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(copy)))
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(placed) < 4 * len(rows)  # all pairs of 28 leaves would send each row 28 times


def test_buckets_follow_the_first_batch_and_stay(spark, monkeypatch):
    assert (buckets_for(0), buckets_for(10**6), buckets_for(5 * 10**9)) == (32, 32, 10_000)
    assert buckets_for(10**12) == 100_000
    monkeypatch.setattr("tabulon.llm.digest_index.BUCKET_ROWS", 2)
    monkeypatch.setattr("tabulon.llm.digest_index.LEAST_BUCKETS", 1)
    made = DigestIndex(spark, "digests_buckets")
    made.drop()
    try:
        rows = [(i, f"text {i}", None, None, 1) for i in range(5)]
        deduplicate(spark.createDataFrame(rows, DOCS), made)
        assert made.buckets == 10
        # Another session's handle appends to the same buckets.
        later = DigestIndex(spark, "digests_buckets", buckets=3)
        more = [(i, f"text {i}", None, None, 1) for i in range(3, 40)]
        got = {r.doc_id: r.kept for r in deduplicate(spark.createDataFrame(more, DOCS), later).collect()}
        assert got == {i: i >= 5 for i in range(3, 40)}
        assert later.buckets == 10 and later.read().count() == 40
    finally:
        made.drop()


def test_parities_never_claim_more_than_sets_differ():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 63, 64, 65, 500, 1025):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for drop, add in ((0, 0), (1, 0), (0, 1), (n // 9, n // 9), (n // 2, 0), (0, 3 * n + 70), (n, n)):
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
            one, other = (ngram_join._rows_of([ngram_join._parity(x)]) for x in (a, b))
            apart = len(np.setxor1d(a, b))
            assert ngram_join._differing(one, other)[0] <= apart
            if len(a) >= 500 and drop == n == add:
                assert ngram_join._differing(one, other)[0] > 0.2 * apart  # a threshold of 80 allows 0.111 of both


def test_long_texts_with_a_common_passage_build_no_sets(spark, monkeypatch):
    """Counts of long unrelated texts are alike; their sets were built and sent to many pairs of leaves."""
    built, original = [], ngram_join._head_links
    monkeypatch.setattr(ngram_join, "_head_links", lambda whole, *rest: built.append(whole.count()) or original(whole, *rest))
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(400)]
    texts = [[f"w{rng.randint(0, 10**6)}" for _ in range(2000)] + passage for _ in range(30)]
    texts.append(["other", *texts[7]])
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 7 if i == 30 else i for i in range(31)}
    assert built == [2]

import math
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.functions import text as tx
from tabulon.operators import corpus
from tabulon.plans.analyses import text_report

REVIEWS = [
    "Python is a great language for data analysis", "I love Python and data science",
    "Machine learning with Python is powerful", "Data analysis needs clean data",
    "Deep learning models need large data", "The football match was exciting",
    "The team won the football game", "A great match and a great team",
    "Players trained hard for the game", "The coach praised the team players",
]


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame([(t,) for t in [*REVIEWS, None, "", "   "]], "review string")


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text", ["", "  ", "one", " two  words ", "a b c", "x\x1cy\x1fz", "tab\tand\nline", "é ß ﬁ"]
)
def test_words_and_blanks_as_python_splits(spark, text):
    assert value(spark, tx.word_count, text) == len(text.split())
    assert value(spark, tx.strip, text) == text.strip()
    assert value(spark, tx.is_blank, text) == (text.strip() == "")
    assert value(spark, tx.clean, text) == " ".join(text.lower().split())
    assert value(spark, tx.char_count, text) == len(text)


@pytest.mark.parametrize("text", ["Hello, hello world_1 a b2", "L'été à Zürich: 3 x 42", "", "naïve café—bar"])
def test_tokens_as_python_finds_them(spark, text):
    assert value(spark, tx.tokens, text) == re.findall(r"\b\w\w+\b", text.lower())


def test_stop_words_keep_repeats(spark):
    words = spark.createDataFrame([("the cat the dog cat",)], "t string").select(tx.tokens(F.col("t")).alias("w"))
    assert tx.without_stop_words(words, "w", ["the"]).first()["w"] == ["cat", "dog", "cat"]


def test_corpus_statistics(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("c d e f",)], "text string")
    r = corpus.corpus_statistics(df, "text").first()
    assert (r["document_count"], r["unique_documents"], r["duplicate_documents"]) == (3, 2, 1)
    assert (r["median_words"], r["minimum_words"], r["maximum_words"]) == (2.0, 2, 4)


def test_usable_documents(reviews):
    assert corpus.corpus_statistics(reviews, "review").first()["document_count"] == 10


def test_word_frequencies(spark):
    df = spark.createDataFrame(
        [("python python data",), ("python code",), ("data python",)], "text string"
    )
    got = [tuple(r) for r in corpus.word_frequencies(df, "text", stop_words=None).collect()]
    assert got == [("python", 4), ("data", 2), ("code", 1)]
    assert len(corpus.word_frequencies(df, "text", top_n=1).collect()) == 1


def test_ngrams_skip_stop_words_first(spark):
    df = spark.createDataFrame([("machine of learning rocks",), ("machine learning",)], "text string")
    got = {r["ngram"]: r["frequency"] for r in corpus.ngrams(df, "text", 2).collect()}
    assert got == {"machine learning": 2, "learning rocks": 1}
    assert [r["ngram"] for r in corpus.ngrams(df, "text", 3).collect()] == ["machine learning rocks"]
    assert corpus.ngrams(df, "text", 9).collect() == []
    with pytest.raises(ValueError):
        corpus.ngrams(df, "text", 0)


def brute_tfidf(texts, limit):
    docs = [Counter(re.findall(r"\b\w\w+\b", t.lower())) for t in texts]
    total = sum(docs, Counter())
    vocabulary = sorted(total, key=lambda w: (-total[w], w))[:limit]
    scores = dict.fromkeys(vocabulary, 0.0)
    for d in docs:
        w = {
            t: d[t] * (math.log((1 + len(docs)) / (1 + sum(t in o for o in docs))) + 1)
            for t in vocabulary if d[t]
        }
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            scores[t] += v / norm / len(docs)
    return scores


@pytest.mark.parametrize("limit", [5, 5000])
def test_tfidf_against_brute_force(spark, reviews, limit):
    got = corpus.tfidf_keywords(reviews, "review", 100, None, limit).collect()
    assert {r["term"]: r["score"] for r in got} == pytest.approx(brute_tfidf(REVIEWS, limit))
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def test_vocabulary_limits(reviews):
    terms, total = corpus.vocabulary(reviews, "review", None, 5000, min_df=2, max_df=0.3)
    rows = terms.collect()
    assert total == 10 and rows
    assert all(2 <= r["document_frequency"] <= 3 for r in rows)
    with pytest.raises(ValueError):
        corpus.vocabulary(reviews, "review", None, 5000, min_df=5, max_df=2)


def test_topics(spark, reviews):
    keyed = reviews.withColumn("id", F.monotonically_increasing_id())
    result = corpus.topic_modeling(keyed, "review", 2, 3, min_df=1, max_df=1.0, keep=["id"])
    topics = result.topics.collect()
    assert result.document_count == 10 and len(topics) == 6
    for topic in (0, 1):
        weights = [r["weight"] for r in sorted(topics, key=lambda r: r["place"]) if r["topic"] == topic]
        assert weights == sorted(weights, reverse=True)
    docs = result.documents.collect()
    assert len(docs) == 10
    for r in docs:
        assert sum(r["topic_probabilities"]) == pytest.approx(1.0)
        assert r["topic_probability"] == max(r["topic_probabilities"])
        assert r["topic_probabilities"][r["dominant_topic"]] == r["topic_probability"]


def test_topic_errors(spark, reviews):
    with pytest.raises(ValueError):
        corpus.topic_modeling(reviews, "review", 1)
    with pytest.raises(ValueError):
        corpus.topic_modeling(reviews, "review", 2, 0)
    with pytest.raises(ValueError):
        corpus.topic_modeling(reviews, "review", 11)
    with pytest.raises(ValueError):
        corpus.topic_modeling(reviews, "review", 2, min_df=10, max_df=1.0)


def test_blank_column_is_refused(spark):
    df = spark.createDataFrame([(None,), (" ",)], "t string")
    for f in (corpus.corpus_statistics, corpus.word_frequencies, corpus.ngrams, corpus.tfidf_keywords):
        with pytest.raises(ValueError, match="no usable text"):
            f(df, "t")


def test_text_report(reviews):
    r = text_report(reviews, "review", (1, 2, 40), top_n=4, keywords=3)
    assert r.statistics.first()["document_count"] == 10 and r.topics is None
    found = {n: [(t["term"], t["frequency"]) for t in r.terms.where(F.col("size") == n).orderBy("place").collect()] for n in (1, 2, 40)}
    assert found[1] == [(t["word"], t["frequency"]) for t in corpus.word_frequencies(reviews, "review", 4).collect()]
    assert found[2] == [(t["ngram"], t["frequency"]) for t in corpus.ngrams(reviews, "review", 2, 4).collect()] and found[40] == []
    assert r.keywords.collect() == corpus.tfidf_keywords(reviews, "review", 3).collect()


def test_stop_words_without_a_session(spark):
    """In a process of its own, which never starts a session."""
    code = "from tabulon.operators.corpus import stop_word_list as s; print(*s('english'))"
    root = Path(corpus.__file__).parents[2]
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True)
    assert made.stdout.split() == corpus.stop_word_list("english")


@pytest.mark.parametrize("counters", [1, 3, 64, 1 << 16])
@pytest.mark.parametrize("top_n", [1, 5, 40, 500])
def test_top_terms_equal_a_plain_count(spark, counters, top_n):
    # Zipf-like counts, many ties, and counters shared by many terms.
    words = [f"w{i}" for i in range(120) for _ in range(max(1, 60 // (i + 1)))]
    want = sorted(Counter(words).items(), key=lambda p: (-p[1], p[0]))[:top_n]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = corpus.top_terms(rows, "word", top_n, counters=counters).collect()
    assert [(r["word"], r["frequency"]) for r in got] == want


def test_top_terms_within_limits_and_empty(spark):
    rows = spark.createDataFrame([("a", 9, 1), ("b", 5, 3), ("c", 5, 2), ("d", 1, 1)], "term string, t int, d int")
    got = corpus.top_terms(rows, "term", 2, F.sum("t"), {"df": F.sum("d")}, F.col("df") >= 2, 2).collect()
    assert [tuple(r) for r in got] == [("b", 5, 3), ("c", 5, 2)]
    assert corpus.top_terms(rows.limit(0), "term", 2, F.sum("t")).collect() == []


def test_term_report_writes_no_rare_terms(spark, monkeypatch):
    """Equal to counting everything, with few counters and small slices; rare runs are counted by hash only."""
    rng = random.Random(4)
    texts = [[rng.choice(["ab", "cd", "é", "x y"]) if rng.random() < 0.5 else f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60))] for _ in range(400)]
    texts += [[], None, ["ab"], ["zz", "zz", "zz", "zz"] * 30]
    words = spark.createDataFrame([(t,) for t in texts], "words array<string>").repartition(3)
    counts = {n: Counter(" ".join(t[i : i + n]) for t in texts if t for i in range(len(t) - n + 1)) for n in (3, 1, 2, 200)}
    want = [(n, w, c, i) for n in counts for i, (w, c) in enumerate(sorted(counts[n].items(), key=lambda p: (-p[1], p[0]))[:7], 1)]
    written, real = [], corpus.materialise

    def materialise(df):
        written.append(df.count())
        return real(df)

    monkeypatch.setattr(corpus, "materialise", materialise)
    for counters in (64, 4096):
        got = corpus.term_report(words, list(counts), 7, counters)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert max(written[-1:]) < sum(map(len, counts.values())) / 4
    monkeypatch.setattr(corpus, "SLICE_TOKENS", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(texts[5:], pa.list_(pa.string())).slice(7)], names=["words"])
    found = Counter()
    for made in corpus._count_exactly([2], np.ones((1, 16), bool), iter([batch])):
        found.update(dict(zip(made.column("term").to_pylist(), made.column("n").to_pylist(), strict=True)))
    assert found == Counter(" ".join(t[i : i + 2]) for t in texts[12:] if t for i in range(len(t) - 1))
    assert corpus.term_report(words.limit(0), [1, 2], 7).count() == 0

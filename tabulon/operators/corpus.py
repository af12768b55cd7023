"""Corpus statistics, word and n-gram counts, TF-IDF keywords and LDA topics."""

from __future__ import annotations

import math
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import text as tx
from tabulon.functions import values as vx
from tabulon.operators.distinct import distinct_counts
from tabulon.session import materialise, persisted, ship_package, spread


def stop_word_list(stop_words: str | Sequence[str] | None) -> list[str]:
    """``"english"`` (or another MLlib language), an own list, or None for no removal."""
    if stop_words is None:
        return []
    if isinstance(stop_words, str):
        if SparkSession.getActiveSession() is not None:
            return list(StopWordsRemover.loadDefaultStopWords(stop_words))
        # Without a session to ask, from the file in the same library.
        (jar,) = (Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar")
        with zipfile.ZipFile(jar) as held:
            return held.read(f"org/apache/spark/ml/feature/stopwords/{stop_words}.txt").decode().splitlines()
    return list(stop_words)


def documents(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """The present, non-blank texts of a column as ``text``, next to the ``keep`` columns."""
    vx.require_columns(df, [column, *keep])
    text = vx.present(df, column).cast("string")
    kept = df.select(*[vx.ref(c) for c in keep], text.alias("text"))
    return kept.where(F.col("text").isNotNull() & ~tx.is_blank(F.col("text")))


def _require_text(df: DataFrame, column: str) -> None:
    if documents(df, column).isEmpty():
        raise ValueError(f"Column '{column}' holds no usable text.")


def cleaned(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    return documents(df, column, keep).withColumn("text", tx.clean(F.col("text")))


def tokenised(df: DataFrame, column: str, stop_words: str | Sequence[str] | None = "english", keep: Sequence[str] = ()) -> DataFrame:
    """``words`` of each usable text, without stop words, next to the ``keep`` columns."""
    # Cleaning changes letter case and whitespace only, which tokenising does anyway.
    words = tx.tokens(F.col("text"))
    found = documents(df, column, keep).select(*[vx.ref(c) for c in keep], words.alias("words"))
    return tx.without_stop_words(found, "words", stop_word_list(stop_words))


def _exploded(df, array, name, *others):
    """One row per element. The outer form keeps the optimizer from also filtering on the
    array's size, which would compute the array once more per row."""
    return df.select(F.explode_outer(array).alias(name), *others).where(F.col(name).isNotNull())


def corpus_statistics(df: DataFrame, column: str) -> DataFrame:
    """Document counts and lengths on the texts as they are. One row."""
    texts = documents(df, column)
    # Few distinct word counts: their sum is at most that of all words.
    sizes = sorted(
        texts.groupBy(tx.word_count(F.col("text")).alias("words"))
        .agg(F.count("*").alias("n"), F.sum(tx.char_count(F.col("text")).cast("long")).alias("chars")).collect()
    )
    if not sizes:
        raise ValueError(f"Column '{column}' holds no usable text.")
    total = sum(r["n"] for r in sizes)
    below = np.cumsum([r["n"] for r in sizes])
    low, high = (sizes[int(np.searchsorted(below, place, side="right"))]["words"] for place in ((total - 1) // 2, total // 2))
    mean, chars = sum(r["words"] * r["n"] for r in sizes) / total, sum(r["chars"] for r in sizes) / total
    unique = distinct_counts(texts, {"text": F.col("text")})["text"]
    return df.sparkSession.createDataFrame(
        [
            (column, total, unique, total - unique, mean, (low + high) / 2, sizes[0]["words"],
             sizes[-1]["words"], chars)
        ],
        "column_name string, document_count long, unique_documents long, "
        "duplicate_documents long, average_words double, median_words double, "
        "minimum_words int, maximum_words int, average_characters double",
    )


#: Counters of the first pass over the terms. A common term stands out from a counter's share of all
#: terms whatever the size of the corpus, so the number need not grow with it.
COUNTERS = 1 << 16


def top_terms(
    terms: DataFrame, name: str, top_n: int, frequency: Column | None = None,
    others: Mapping[str, Column] | None = None, within: Column | None = None, counters: int = COUNTERS,
) -> DataFrame:
    """(name, frequency, others) of the most frequent values of a column of single terms; ties ascending.

    The first pass counts by the term's hash, so a task sends at most ``counters`` numbers
    instead of every rare term. No term is more frequent than its counter. Terms of the
    fullest counters are counted exactly; the count in place ``top_n`` is a proven floor. If
    counters below those reach the floor, their terms are counted exactly too, in one more pass.
    ``frequency`` and ``others`` are aggregates, ``within`` says which terms may be listed.
    """
    frequency = F.count(F.lit(1)) if frequency is None else frequency
    measures = [frequency.alias("frequency"), *[c.alias(n) for n, c in (others or {}).items()]]
    counter = F.pmod(F.xxhash64(name), F.lit(counters)).cast("int")
    totals = materialise(terms.groupBy(counter.alias("counter")).agg(frequency.alias("total")))

    def counted(floor, below=None):
        chosen = F.col("total") >= floor
        if below is not None:
            chosen &= F.col("total") < below
        # At most as many numbers as there are counters.
        kept = F.broadcast(totals.where(chosen).select("counter"))
        found = terms.withColumn("counter", counter).join(kept, "counter", "left_semi").groupBy(name).agg(*measures)
        return found if within is None else found.where(within)

    best = [F.desc("frequency"), name]
    # A few counters per wanted place, as some hold many rare terms.
    fullest = [r["total"] for r in totals.orderBy(F.desc("total")).limit(4 * top_n).collect()]
    if not fullest:
        return counted(1).limit(0)
    guess = fullest[-1]
    found = materialise(counted(guess).orderBy(*best).limit(top_n))
    reached, floor = found.agg(F.count(F.lit(1)), F.min("frequency")).first()
    floor = floor if reached == top_n else 1
    if floor < guess and not totals.where((F.col("total") >= floor) & (F.col("total") < guess)).isEmpty():
        found = found.unionByName(counted(floor, guess))
    return found.orderBy(*best).limit(top_n)


def word_frequencies(
    df: DataFrame,
    column: str,
    top_n: int = 20,
    stop_words: str | Sequence[str] | None = "english",
) -> DataFrame:
    """The most frequent words of the corpus; ties alphabetical."""
    _require_text(df, column)
    listed = stop_word_list(stop_words)
    words = _exploded(tokenised(df, column, None), F.col("words"), "word")
    # Room for every stop word, so that they need not be looked for in every text.
    best = top_terms(words, "word", top_n + len(listed))
    return best.where(~F.col("word").isin(listed)).orderBy(F.desc("frequency"), "word").limit(top_n)


def ngrams(
    df: DataFrame,
    column: str,
    n: int = 2,
    top_n: int = 20,
    stop_words: str | Sequence[str] | None = "english",
) -> DataFrame:
    """The most frequent runs of n words, formed after stop words are removed."""
    if n < 1:
        raise ValueError("An n-gram holds one word or more.")
    _require_text(df, column)
    runs = tx.with_ngrams(tokenised(df, column, stop_words), "words", n, "runs")
    return top_terms(_exploded(runs, F.col("runs"), "ngram"), "ngram", top_n)


#: Tokens that a task looks at together, about.
SLICE_TOKENS = 1 << 20


def _runs_of(batch: pa.RecordBatch, sizes: Sequence[int], counters: int):
    """Per slice of texts and size: (number of the size, codes of the tokens, dictionary, first places, counters)."""
    words = batch.column(0).drop_null()
    ends = words.offsets.to_numpy()
    begin = 0
    while begin < len(words):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE_TOKENS, side="right")) - 1)
        held = words.slice(begin, end - begin)
        lengths = np.diff(ends[begin:end + 1])
        begin = end
        coded = held.flatten().dictionary_encode()
        if not len(coded):
            continue
        codes = coded.indices.to_numpy().astype(np.int64)
        hashed = np.array([zlib.crc32(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)[codes]
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # tokens from here to the end of the text
        for i, n in enumerate(sizes):
            first = np.flatnonzero(left >= n)
            mixed = np.zeros(len(first), np.uint64)
            for t in range(n):
                mixed = (mixed ^ hashed[first + t]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            yield i, codes, coded.dictionary, first, (mixed % np.uint64(counters)).astype(np.int64)


def _count_by_counter(sizes: Sequence[int], counters: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((len(sizes), counters), np.int64)
    for batch in batches:
        for i, _, _, _, at in _runs_of(batch, sizes, counters):
            totals[i] += np.bincount(at, minlength=counters)
    i, at = np.nonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(at, pa.int32()), pa.array(totals[i, at])], names=["i", "counter", "n"])


def _count_exactly(sizes: Sequence[int], kept: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, codes, dictionary, first, at in _runs_of(batch, sizes, kept.shape[1]):
            first = first[kept[i][at]]
            number = np.zeros(len(first), np.int64)
            for t in range(sizes[i]):
                _, number = np.unique(number * len(dictionary) + codes[first + t], return_inverse=True)
            _, place, n = np.unique(number, return_index=True, return_counts=True)
            parts = [dictionary.take(pa.array(codes[first[place] + t])) for t in range(sizes[i])]
            term = pc.binary_join_element_wise(*parts, " ")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i, np.int32)), term, pa.array(n)], names=["i", "term", "n"])


def term_report(words: DataFrame, sizes: Sequence[int], top_n: int = 20, counters: int = COUNTERS) -> DataFrame:
    """(size, term, frequency, place) of the most frequent runs of ``sizes`` words; ties ascending.

    ``words`` holds arrays of tokens, best written once, as they are read twice or, for runs that
    are all about equally rare, three times. As in ``top_terms``, all runs are counted by hash
    and only those that may be listed exactly; here for all sizes at once, on numbered tokens.
    """
    if min(sizes, default=1) < 1:
        raise ValueError("An n-gram holds one word or more.")
    spark, sizes = words.sparkSession, list(sizes)
    ship_package(spark)
    words = words.select("words")
    found = words.mapInArrow(partial(_count_by_counter, sizes, counters), "i int, counter int, n long")
    found = found.groupBy("i", "counter").agg(F.sum("n").alias("n")).toArrow()  # one line per size and counter
    totals = np.zeros((len(sizes), counters), np.int64)
    totals[found.column("i").to_numpy(), found.column("counter").to_numpy()] = found.column("n").to_numpy()

    def counted(kept):
        """The first ``top_n`` (frequency, term) per size among the kept counters' terms."""
        terms = words.mapInArrow(partial(_count_exactly, sizes, kept), "i int, term string, n long")
        exact = materialise(terms.groupBy("i", "term").agg(F.sum("n").alias("n")))
        return [exact.where(F.col("i") == i).orderBy(F.desc("n"), "term").limit(top_n).collect() for i in range(len(sizes))]

    # A few counters per wanted place, as some hold many rare terms.
    guess = np.maximum(np.sort(totals, axis=1)[:, ::-1][:, min(4 * top_n, counters) - 1], 1)
    best = counted(totals >= guess[:, None])
    floor = np.array([rows[-1]["n"] if len(rows) == top_n else 1 for rows in best])
    rest = (totals >= floor[:, None]) & (totals < guess[:, None])
    if rest.any():
        best = [sorted([*a, *b], key=lambda r: (-r["n"], r["term"].encode()))[:top_n] for a, b in zip(best, counted(rest), strict=True)]
    lines = [(n, r["term"], r["n"], place) for n, rows in zip(sizes, best, strict=True) for place, r in enumerate(rows, 1)]
    return spark.createDataFrame(lines, "size int, term string, frequency long, place int")


def vocabulary(
    df: DataFrame,
    column: str,
    stop_words: str | Sequence[str] | None = "english",
    max_features: int = 5000,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
) -> tuple[DataFrame, int]:
    """The ``max_features`` most frequent terms within the document-frequency limits, and
    the number of documents.

    Whole-number limits count documents, fractional ones are shares of all documents.
    Each row gives its tokens and its distinct tokens, so only (term, partial sums) is
    shuffled and no (document, term) pair is.
    """
    if max_features < 1:
        raise ValueError("The vocabulary needs room for a term.")
    total = documents(df, column).count()
    if not total:
        raise ValueError(f"Column '{column}' holds no usable text.")
    low = min_df if isinstance(min_df, int) else min_df * total
    high = max_df if isinstance(max_df, int) else max_df * total
    if high < low:
        raise ValueError("The document-frequency limits exclude every term.")
    once = F.array(
        F.struct(F.col("words").alias("w"), F.lit(1).alias("t"), F.lit(0).alias("d")),
        F.struct(F.array_distinct("words").alias("w"), F.lit(0).alias("t"), F.lit(1).alias("d")),
    )
    marked = tokenised(df, column, None).select(F.inline(once))
    within = F.col("document_frequency").between(low, high)
    listed = stop_word_list(stop_words)
    if listed:  # cheaper on the distinct terms than on every token
        within &= ~F.col("term").isin(listed)
    terms = top_terms(
        _exploded(marked, F.col("w"), "term", "t", "d"), "term", max_features, F.sum("t"),
        {"document_frequency": F.sum("d")}, within, max(COUNTERS, 64 * max_features),
    )
    return terms.withColumnRenamed("frequency", "term_count"), total


def _vectors(df, column, terms, keep=()):
    """Sparse counts over a fixed vocabulary (without stop words), row by row and unshuffled."""
    model = CountVectorizerModel.from_vocabulary(terms, inputCol="words", outputCol="counts")
    return model.transform(tokenised(df, column, None, keep))


def tfidf_keywords(
    df: DataFrame,
    column: str,
    top_n: int = 20,
    stop_words: str | Sequence[str] | None = "english",
    max_features: int = 5000,
) -> DataFrame:
    """Terms by their mean TF-IDF weight over all documents.

    idf = ln((1 + N) / (1 + df)) + 1 and every document vector has length 1. The
    vocabulary (at most ``max_features`` terms) is the only thing the tasks share; the
    weights are computed inside each row and summed as vectors.
    """
    table, total = vocabulary(df, column, stop_words, max_features)
    terms = table.collect()
    if not terms:
        raise ValueError("The texts hold nothing but stop words.")
    idf = [math.log((1 + total) / (1 + t["document_frequency"])) + 1 for t in terms]
    weigh = PipelineModel(
        [
            ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weights"),
            Normalizer(p=2.0, inputCol="weights", outputCol="unit"),
        ]
    )
    unit = weigh.transform(_vectors(df, column, [t["term"] for t in terms]))
    # Two steps, so that no single task merges one vector per input partition.
    partial = unit.groupBy((F.spark_partition_id() % 64).alias("part")).agg(
        Summarizer.sum(F.col("unit")).alias("unit")
    )
    summed = partial.agg(vector_to_array(Summarizer.sum(F.col("unit"))).alias("sums")).first()["sums"]
    scores = sorted(
        ((t["term"], s / total) for t, s in zip(terms, summed, strict=True)),
        key=lambda pair: (-pair[1], pair[0]),
    )
    return df.sparkSession.createDataFrame(scores[:top_n], "term string, score double")


@dataclass(frozen=True)
class TopicModel:
    """``topics``: (topic, place, word, weight); ``documents``: one row per text."""

    document_count: int
    n_topics: int
    vocabulary: list[str]
    topics: DataFrame
    documents: DataFrame
    model: object
    vectorizer: CountVectorizerModel


def topic_modeling(
    df: DataFrame,
    column: str,
    n_topics: int = 5,
    words_per_topic: int = 10,
    max_features: int = 5000,
    min_df: int | float = 2,
    max_df: int | float = 0.95,
    stop_words: str | Sequence[str] | None = "english",
    random_state: int = 42,
    max_iter: int = 10,
    keep: Sequence[str] = (),
) -> TopicModel:
    """Variational LDA on word counts, every document in every iteration.

    ``keep`` names columns (such as a key) to carry to the documents table.
    """
    if n_topics < 2:
        raise ValueError("A topic model has two topics or more.")
    if words_per_topic < 1:
        raise ValueError("A topic is shown by one word or more.")
    table, total = vocabulary(df, column, stop_words, max_features, min_df, max_df)
    if total < n_topics:
        raise ValueError("There are fewer documents than topics.")
    terms = [t["term"] for t in table.collect()]
    if not terms:
        raise ValueError("The document-frequency limits and stop words leave no term.")
    counts = spread(_vectors(df, column, terms, keep).drop("words"))
    estimator = LDA(
        k=n_topics,
        maxIter=max_iter,
        seed=random_state,
        optimizer="online",
        subsamplingRate=1.0,
        optimizeDocConcentration=False,
        docConcentration=[1.0 / n_topics] * n_topics,
        topicConcentration=1.0 / n_topics,
        featuresCol="counts",
    )
    with persisted(counts):
        model = estimator.fit(counts)

    spark = df.sparkSession
    weights = model.topicsMatrix().toArray()
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "word")
    topics = (
        spark.createDataFrame(
            [(word, weights[i].tolist()) for i, word in enumerate(terms)],
            "word string, weights array<double>",
        )
        .select("word", F.posexplode("weights").alias("topic", "weight"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= words_per_topic)
        .select("topic", "place", "word", "weight")
    )
    mix = vector_to_array("topicDistribution")
    even = F.array_repeat(F.lit(1.0 / n_topics), n_topics)
    docs = (
        model.transform(counts)
        .select(*[vx.ref(c) for c in keep], mix.alias("mix"))
        # A text without a known word gets the prior: every topic alike.
        .withColumn("mix", F.when(F.array_max("mix") > 0, F.col("mix")).otherwise(even))
        .select(
            *[vx.ref(c) for c in keep],
            (F.array_position("mix", F.array_max("mix")) - 1).cast("int").alias("dominant_topic"),
            F.array_max("mix").alias("topic_probability"),
            F.col("mix").alias("topic_probabilities"),
        )
    )
    vectorizer = CountVectorizerModel.from_vocabulary(terms, inputCol="words", outputCol="counts")
    return TopicModel(total, n_topics, terms, topics, docs, model, vectorizer)

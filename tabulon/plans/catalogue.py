"""The registered queries: every operator run over the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text as tx
from tabulon.functions import values as vx
from tabulon.operators import (
    association,
    clustering,
    corpus,
    corrections,
    describe,
    distinct,
    features,
    fold_features,
    folds,
    forest,
    lloyd,
    metrics,
    perceptron,
    profile,
    profile_states,
    supervised,
)
from tabulon.plans import analyses
from tabulon.session import new_path, remove, shared_folder
from tabulon.sources import tables

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{folder.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- reading --------------------------------------------------------------------------


@query
def preview_rows(spark, folder):
    return tables.preview(load(spark, folder, "orders"), 10, "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )


@query
def dataset_names(spark, folder):
    parts = [
        tables.with_dataset_name(load(spark, folder, t)).groupBy("dataset_name").count()
        for t in ("orders", "customer", "events")
    ]
    return union(parts).withColumnRenamed("count", "n")


@query
def csv_roundtrip(spark, folder):
    """Customers written as CSV with missing tokens and read back with inferred types."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}.csv"
    customer = load(spark, folder, "customer")
    customer.withColumn(
        "c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment"))
    ).withColumn("owes", F.when(F.col("c_acctbal") < 0, "True").otherwise("False")).write.option(
        "header", True
    ).csv(path)
    return tables.read_table(spark, path)


# --- projections ----------------------------------------------------------------------


@query
def pairwise_rows(spark, folder):
    t = load(spark, folder, "lineitem").select(
        F.nullif("l_quantity", F.lit(50.0)).alias("x"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).otherwise(float("nan")).alias("y"),
    )
    return vx.drop_missing_pair(t, "x", "y").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@query
def coerce_numeric(spark, folder):
    t = load(spark, folder, "events").select(
        F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.get_json_object("props", "$.k")).alias("k")
    )
    return rounded(
        describe.numeric_statistics(t, ["k"]), 6, "mean", "standard_deviation"
    )


@query
def clean_texts(spark, folder):
    text = tx.clean(F.col("text"))
    return load(spark, folder, "documents").select(
        "doc_id", F.md5(text).alias("digest"), tx.char_count(text).alias("chars")
    )


@query
def text_lengths(spark, folder):
    return load(spark, folder, "documents").select(
        "doc_id", tx.word_count(F.col("text")).alias("words"), tx.char_count(F.col("text")).alias("chars")
    )


@query
def token_counts(spark, folder):
    found = load(spark, folder, "documents").select("doc_id", tx.tokens(F.col("text")).alias("words"))
    kept = tx.without_stop_words(found, "words", corpus.stop_word_list("english"))
    return kept.select("doc_id", F.size("words").alias("tokens"))


# --- profiles -------------------------------------------------------------------------

PROFILE_COLUMNS = ["column_name", "column_type", "missing_count", "missing_percentage", "unique_count"]


@query
def profile_orders(spark, folder):
    return profile.profile_dataset(load(spark, folder, "orders")).columns.select(*PROFILE_COLUMNS)


@query
def profile_events(spark, folder):
    t = load(spark, folder, "events").withColumn("value", F.when(F.col("value") < 50, F.col("value")))
    return profile.profile_dataset(t).columns.select(*PROFILE_COLUMNS)


@query
def profile_documents(spark, folder):
    return profile.profile_dataset(load(spark, folder, "documents")).columns.select(
        *PROFILE_COLUMNS, "average_words", "max_words", "average_characters"
    )


@query
def profile_incremental(spark, folder):
    """Profiles of two tables from states per file; the sketches are held against exact counts."""
    parts = []
    for name in ("lineitem", "documents"):
        states = new_path(spark, "states")
        found = profile_states.incremental_profile(spark, f"{folder.rstrip('/')}/{name}.parquet", states)
        t = load(spark, folder, name)
        exact = distinct.distinct_counts(t, {c: vx.comparable(t, c) for c in t.columns})
        schema = found.schema
        found = spark.createDataFrame(found.collect(), schema)  # one row per column, so the states can go
        remove(spark, states)
        counts = spark.createDataFrame(list(exact.items()), "column_name string, exact long")
        apart = F.abs(F.col("unique_estimate") - F.col("exact"))
        parts.append(
            found.join(counts, "column_name").select(
                F.lit(name).alias("source_table"), "column_name", "column_type", "row_count", "missing_count",
                "average_words", "max_words", "average_characters", "minimum", "maximum", "mean", "standard_deviation",
                (apart <= 4 * F.col("unique_error") * F.col("exact")).alias("unique_fits"),
            )
        )
    return rounded(union(parts), 4, "mean", "standard_deviation")


@query
def dataset_row(spark, folder):
    p = profile.profile_dataset(load(spark, folder, "documents").select("text", "lang"))
    return spark.createDataFrame(
        [(p.row_count, p.column_count, p.duplicate_rows)],
        "row_count long, column_count int, duplicate_rows long",
    )


@query
def text_columns(spark, folder):
    t = load(spark, folder, "documents")
    return spark.createDataFrame([(c,) for c in profile.detect_text_columns(t)], "column_name string")


def _gappy_lineitem(spark, folder):
    return load(spark, folder, "lineitem").withColumns(
        {
            "l_quantity": F.nullif("l_quantity", F.lit(50.0)),
            "l_discount": F.nullif("l_discount", F.lit(0.0)),
            "l_returnflag": F.nullif("l_returnflag", F.lit("R")),
        }
    )


@query
def top_missing(spark, folder):
    return profile.top_missing(_gappy_lineitem(spark, folder), 30)


@query
def total_missing_cells(spark, folder):
    p = profile.profile_dataset(_gappy_lineitem(spark, folder), duplicates=False)
    return profile.total_missing_cells(p)


@query
def testable_columns(spark, folder):
    return profile.testable_columns(profile.profile_dataset(load(spark, folder, "lineitem")))


# --- descriptive statistics -----------------------------------------------------------


@query
def describe_numeric(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]
    return rounded(
        describe.numeric_statistics(_gappy_lineitem(spark, folder), columns), 4,
        "mean", "standard_deviation", "first_quartile", "median", "third_quartile",
    )


@query
def describe_categorical(spark, folder):
    return describe.categorical_statistics(
        _gappy_lineitem(spark, folder), ["l_returnflag", "l_linestatus"]
    ).drop("top_values")


@query
def describe_categorical_top(spark, folder):
    return describe.top_values(
        load(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], 3
    )


@query
def describe_text(spark, folder):
    parts = [
        describe.text_statistics(load(spark, folder, t), ["text"]).withColumn("source_table", F.lit(t))
        for t in ("documents", "conversations")
    ]
    return rounded(union(parts), 6, "average_words", "average_characters")


@query
def describe_datetime(spark, folder):
    orders = load(spark, folder, "orders").select(
        "o_orderdate",
        F.when(F.col("o_orderstatus") == "P", "soon")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_text"),
    )
    return describe.datetime_statistics(load(spark, folder, "events"), ["ts"]).unionByName(
        describe.datetime_statistics(orders, ["o_orderdate", "order_text"])
    )


@query
def describe_boolean(spark, folder):
    t = load(spark, folder, "labels").select(
        (F.col("quality") == 1).alias("good"),
        F.when(F.col("quality") == 1, F.col("toxic") == 1).alias("toxic_if_good"),
    )
    return describe.boolean_statistics(t, ["good", "toxic_if_good"])


@query
def describe_other(spark, folder):
    return describe.other_statistics(load(spark, folder, "embeddings"), ["embedding"])


@query
def dataset_sections(spark, folder):
    """Counts of every section of the full report, whatever the section."""
    t = load(spark, folder, "orders").withColumn("big", F.col("o_totalprice") > 200000)
    sections = describe.dataset_statistics(t, profile.profile_dataset(t))
    return union(
        s.select(F.lit(name).alias("section"), "column_name", "count", "missing_count")
        for name, s in sections.items()
        if s is not None and name != "dataset"
    )


@query
def column_report(spark, folder):
    t = load(spark, folder, "orders")
    section, statistics = describe.column_statistics(t, "o_totalprice", profile.profile_dataset(t))
    return rounded(statistics, 4, "mean", "standard_deviation", "first_quartile", "median",
                   "third_quartile").withColumn("section", F.lit(section))


# --- association ----------------------------------------------------------------------


@query
def spearman(spark, folder):
    t = load(spark, folder, "lineitem")
    return rounded(
        association.spearman_correlation(t, "l_quantity", "l_extendedprice"), 6, "statistic", "p_value"
    )


@query
def mann_whitney(spark, folder):
    t = load(spark, folder, "lineitem")
    return rounded(
        association.mann_whitney_test(t, "l_extendedprice", "l_linestatus"), 6,
        "p_value", "rank_biserial", "group_1_median", "group_2_median",
    )


@query
def mann_whitney_exact(spark, folder):
    t = load(spark, folder, "nation").withColumn("first_region", F.col("n_regionkey") == 0)
    return rounded(
        association.mann_whitney_test(t, "n_nationkey", "first_region"), 9, "p_value", "rank_biserial"
    )


@query
def crosstab(spark, folder):
    t = load(spark, folder, "lineitem")
    return association.contingency_table(t, "l_returnflag", "l_linestatus")


@query
def chi_square_v(spark, folder):
    t = load(spark, folder, "orders")
    return rounded(
        association.categorical_association(t, "o_orderstatus", "o_orderpriority").test, 6,
        "chi_square", "p_value", "cramers_v", "minimum_expected_count",
    )


@query
def binary_phi(spark, folder):
    t = load(spark, folder, "labels")
    return rounded(
        association.binary_association(t, "quality", "toxic").test, 6,
        "chi_square", "p_value", "phi", "minimum_expected_count",
    )


@query
def kruskal(spark, folder):
    t = load(spark, folder, "lineitem")
    return rounded(
        association.kruskal_wallis_test(t, "l_extendedprice", "l_returnflag").test, 6,
        "statistic", "p_value",
    )


@query
def kruskal_groups(spark, folder):
    t = load(spark, folder, "lineitem")
    groups = association.kruskal_wallis_test(t, "l_extendedprice", "l_returnflag").groups
    return rounded(groups, 6, "median")


@query
def posthoc_holm(spark, folder):
    t = load(spark, folder, "documents")
    return rounded(
        association.mann_whitney_posthoc(t, "n_chars", "lang"), 6,
        "p_value", "adjusted_p_value", "rank_biserial", "group_1_median", "group_2_median",
    )


def _many_groups(spark, folder):
    return load(spark, folder, "lineitem").select(
        "l_extendedprice", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("slot")
    )


@query
def kruskal_many_groups(spark, folder):
    """More groups than get a column each: ranks are joined on instead."""
    test = association.kruskal_wallis_test(_many_groups(spark, folder), "l_extendedprice", "slot").test
    return rounded(test, 6, "statistic", "p_value")


@query
def kruskal_many_medians(spark, folder):
    groups = association.kruskal_wallis_test(_many_groups(spark, folder), "l_extendedprice", "slot").groups
    return rounded(groups, 6, "median")


@query
def posthoc_many_groups(spark, folder):
    pairs = association.mann_whitney_posthoc(_many_groups(spark, folder), "l_extendedprice", "slot")
    return rounded(
        pairs, 6, "p_value", "adjusted_p_value", "rank_biserial", "group_1_median", "group_2_median"
    )


@query
def posthoc_corrections(spark, folder):
    """Every correction over the same comparisons."""
    t = load(spark, folder, "events")
    pairs = association.mann_whitney_posthoc(t, "value", "event_type").select(
        "group_1", "group_2", "p_value"
    )
    m = pairs.count()
    parts = [
        corrections.adjust(pairs, "p_value", m, method).withColumn("correction", F.lit(method))
        for method in corrections.METHODS
    ]
    return rounded(union(parts), 6, "p_value", "adjusted_p_value")


@query
def kruskal_gated(spark, folder):
    t = load(spark, folder, "events")
    result = association.kruskal_wallis_with_posthoc(t, "value", "event_type", alpha=0.05)
    compared = 0 if result.posthoc is None else result.posthoc.count()
    return rounded(
        result.global_test.test.withColumn("comparisons", F.lit(compared).cast("long")), 6,
        "statistic", "p_value",
    )


# --- features -------------------------------------------------------------------------


def _gappy_customer(spark, folder):
    return load(spark, folder, "customer").select(
        "c_custkey", "c_nationkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        F.lit(1).alias("constant"),
    )


def _scaled(scaling):
    def run(spark, folder):
        p = features.prepare_clustering_data(
            _gappy_customer(spark, folder), ["c_acctbal", "c_nationkey"], [], scaling
        )
        v = vector_to_array("features")
        return rounded(
            p.data.select("c_custkey", v[0].alias("balance"), v[1].alias("nation")), 6,
            "balance", "nation",
        )

    run.__name__ = f"impute_scale_{scaling}"
    return query(run)


for _name in features.SCALINGS:
    _scaled(_name)


@query
def one_hot(spark, folder):
    p = features.prepare_clustering_data(
        _gappy_customer(spark, folder), [], ["c_mktsegment"], "none"
    )
    v = vector_to_array("features")
    return p.data.select(
        "c_custkey", *[v[i].alias(name) for i, name in enumerate(p.feature_names)]
    )


def _fold_scaling(scaling):
    def run(spark, folder):
        t = _gappy_customer(spark, folder).withColumn("fold", (F.col("c_custkey") % 4).cast("int"))
        return rounded(
            fold_features.scaling_by_fold(t, ["c_acctbal", "c_nationkey"], 4, scaling), 6, "fill", "centre", "scale"
        )

    run.__name__ = f"fold_scaling_{scaling}"
    return query(run)


for _name in ("standard", "robust", "minmax"):
    _fold_scaling(_name)


@query
def removed_columns(spark, folder):
    p = features.prepare_clustering_data(
        _gappy_customer(spark, folder), ["c_acctbal", "constant"], ["c_mktsegment"]
    )
    rows = [(c, "removed") for c in p.removed_columns] + [(c, "feature") for c in p.feature_names]
    return spark.createDataFrame(rows, "column_name string, kept_as string")


# --- clustering -----------------------------------------------------------------------


def _vectors(spark, folder):
    return load(spark, folder, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


@query
def cluster_indices(spark, folder):
    """With the Euclidean silhouette, exact while the clusters fit the reference rows."""
    return rounded(
        clustering.cluster_indices(_vectors(spark, folder), "label", silhouette="euclidean"), 6,
        "silhouette_score", "calinski_harabasz_score", "davies_bouldin_score", "inertia",
    )


@query
def cluster_indices_squared(spark, folder):
    return rounded(
        clustering.cluster_indices(_vectors(spark, folder), "label"), 6,
        "silhouette_score", "calinski_harabasz_score", "davies_bouldin_score", "inertia",
    )


@query
def label_sizes(spark, folder):
    return clustering.cluster_sizes(_vectors(spark, folder), "label")


@query
def kmeans_best_k(spark, folder):
    t = load(spark, folder, "customer")
    result = analyses.kmeans_analysis(t, ["c_acctbal", "c_nationkey"], ["c_mktsegment"])
    return result.best_k.results.withColumn("best_k", F.lit(result.best_k.best_k))


@query
def kmeans_fixed_centers(spark, folder):
    """The nearest of two and of three given centres for every customer."""
    t = load(spark, folder, "customer")
    point = F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"))
    centers = {2: [[0.0, 5.0], [6000.0, 20.0]], 3: [[-500.0, 0.0], [4000.0, 12.0], [9000.0, 24.0]]}
    return t.select("c_custkey", *[lloyd.assigned(point, np.array(c)).alias(f"cluster_of_{k}") for k, c in centers.items()])


@query
def kmeans_step(spark, folder):
    """One step of several K at once: the rows and the mean of every cluster of the given centres."""
    t = load(spark, folder, "customer")
    vectors = t.select(F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double")).alias("v"))
    centers = {2: [[0.0, 5.0], [6000.0, 20.0]], 3: [[-500.0, 0.0], [4000.0, 12.0], [9000.0, 24.0]]}
    found = lloyd.sums_by_cluster(vectors, {k: np.array(c) for k, c in centers.items()})
    rows = [(k, i, n, float(mean[0]), float(mean[1])) for k, held in found.items() for i, (n, mean, *_) in held.items()]
    made = spark.createDataFrame(rows, "k int, cluster int, n long, balance double, nation double")
    return rounded(made, 6, "balance", "nation")


@query
def kmeans_clusters(spark, folder):
    found = clustering.run_kmeans(_vectors(spark, folder), 4)
    return clustering.cluster_sizes(found.labels).join(found.centers, "cluster")


# --- text mining ----------------------------------------------------------------------


@query
def corpus_stats(spark, folder):
    parts = [
        corpus.corpus_statistics(load(spark, folder, t), "text").withColumn("source_table", F.lit(t))
        for t in ("documents", "conversations")
    ]
    return rounded(union(parts), 6, "average_words", "average_characters")


@query
def word_freq(spark, folder):
    return corpus.word_frequencies(load(spark, folder, "documents"), "text", 20)


@query
def word_freq_all(spark, folder):
    return corpus.word_frequencies(load(spark, folder, "conversations"), "text", 20, None)


@query
def bigrams(spark, folder):
    return corpus.ngrams(load(spark, folder, "documents"), "text", 2, 20)


@query
def text_report_terms(spark, folder):
    """Words, bigrams and trigrams from one tokenised table."""
    return analyses.text_report(load(spark, folder, "documents"), "text", (1, 2, 3)).terms.drop("place")


@query
def trigrams(spark, folder):
    return corpus.ngrams(load(spark, folder, "documents"), "text", 3, 20)


@query
def tfidf_keywords(spark, folder):
    return rounded(corpus.tfidf_keywords(load(spark, folder, "documents"), "text", 20), 8, "score")


@query
def vocab_df_limits(spark, folder):
    terms, _ = corpus.vocabulary(
        load(spark, folder, "documents"), "text", max_features=5000, min_df=2, max_df=0.95
    )
    return terms


@query
def lda_topics(spark, folder):
    t = load(spark, folder, "documents")
    return corpus.topic_modeling(t, "text", 4, 8).topics


@query
def lda_mixtures(spark, folder):
    """Every document has one mixture, and its shares sum to one."""
    t = load(spark, folder, "documents")
    docs = corpus.topic_modeling(t, "text", 3, 5, keep=["doc_id"]).documents
    total = F.aggregate("topic_probabilities", F.lit(0.0), lambda a, b: a + b)
    return docs.select("doc_id", F.round(total, 6).alias("total"))


@query
def lda_documents(spark, folder):
    t = load(spark, folder, "documents")
    return corpus.topic_modeling(t, "text", 4, 8, keep=["doc_id"]).documents


# --- supervised -----------------------------------------------------------------------


@query
def detect_task(spark, folder):
    found = []
    for table, column in (
        ("orders", "o_orderstatus"), ("orders", "o_totalprice"), ("lineitem", "l_linenumber"),
        ("part", "p_size"), ("labels", "quality"),
    ):
        d = supervised.detect_task_type(load(spark, folder, table), column)
        found.append((d.target_column, d.task_type, d.unique_target_values, d.warning is not None))
    return spark.createDataFrame(
        found, "target_column string, task_type string, unique_target_values long, warned boolean"
    )


@query
def fold_sizes_stratified(spark, folder):
    t = load(spark, folder, "labels")
    table, _, _ = folds.assign_folds(t, "classification", "doc_id", "quality", 7)
    return table.groupBy("quality", "fold").agg(F.count("*").alias("n"))


@query
def fold_sizes(spark, folder):
    t = load(spark, folder, "customer")
    table, _, _ = folds.assign_folds(t, "regression", "c_custkey", "c_acctbal", 7)
    return table.groupBy("fold").agg(F.count("*").alias("n"))


@query
def class_weights(spark, folder):
    return rounded(folds.class_weights(load(spark, folder, "orders"), "o_orderstatus"), 9, "weight")


@query
def class_metrics(spark, folder):
    t = load(spark, folder, "labels")
    return rounded(metrics.classification_metrics(t, "quality", "toxic"), 9, *metrics.CLASSIFICATION)


@query
def reg_metrics(spark, folder):
    t = load(spark, folder, "lineitem").withColumn("guess", F.col("l_quantity") * 2000.0)
    return rounded(metrics.regression_metrics(t, "l_extendedprice", "guess"), 4, *metrics.REGRESSION)


def _fold_scores(spark, folder):
    t = load(spark, folder, "orders").select(
        (F.col("o_orderkey") % 5).cast("int").alias("fold"), "o_totalprice",
        (F.col("o_custkey") * 100.0).alias("guess"),
    )
    return metrics.regression_metrics(t, "o_totalprice", "guess", ["fold"])


@query
def fold_summary(spark, folder):
    table = metrics.summarise_folds(_fold_scores(spark, folder), metrics.REGRESSION, 1)
    return rounded(table.drop("fold_scores"), 4, "mean", "standard_deviation", "minimum", "maximum")


@query
def fold_summary_population(spark, folder):
    table = metrics.summarise_folds(_fold_scores(spark, folder), metrics.REGRESSION, 0)
    return rounded(table.drop("fold_scores"), 4, "mean", "standard_deviation", "minimum", "maximum")


def _document_features(spark, folder):
    """Features of the labelled documents, joined on their id."""
    documents = load(spark, folder, "documents")
    described = documents.select(
        "doc_id", "lang", "source", "n_chars",
        tx.word_count(F.col("text")).alias("words"),
        F.regexp_count("text", F.lit("\n")).alias("line_breaks"),
    )
    return described.join(load(spark, folder, "labels"), "doc_id")


@query
def forest_cv(spark, folder):
    t = _document_features(spark, folder)
    result = forest.train_random_forest(
        t, profile.profile_dataset(t, duplicates=False), "quality", key="doc_id",
        exclude_columns=["doc_id", "toxic"],
    )
    return result.cross_validation.metrics


@query
def forest_held_out(spark, folder):
    """Every labelled document is predicted once, in the fold that left it out."""
    t = _document_features(spark, folder)
    result = forest.cross_validate_random_forest(
        supervised.prepare_supervised_data(
            t, profile.profile_dataset(t, duplicates=False), "quality", key="doc_id",
            exclude_columns=["doc_id", "toxic"],
        ),
        forest.build_random_forest("classification"), 3,
    )
    predicted = result.predictions.where(F.col("prediction").isin(0.0, 1.0))
    return predicted.groupBy(F.col("truth").cast("int").alias("quality"), "fold").agg(
        F.count("*").alias("n")
    )


@query
def forest_importance(spark, folder):
    t = load(spark, folder, "orders").drop("o_orderdate")
    prepared = supervised.prepare_supervised_data(
        t, profile.profile_dataset(t, duplicates=False), "o_totalprice", key="o_orderkey",
        exclude_columns=["o_orderkey"],
    )
    estimator = forest.build_random_forest("regression")
    pipeline, names = forest.fit_final_random_forest(prepared, estimator)
    return forest.feature_importance(pipeline, names, spark)


@query
def network_cv(spark, folder):
    t = _document_features(spark, folder)
    prepared = supervised.prepare_supervised_data(
        t, profile.profile_dataset(t, duplicates=False), "quality", key="doc_id",
        exclude_columns=["doc_id", "toxic"],
    )
    return perceptron.cross_validate_network(prepared, [8]).metrics


@query
def network_history(spark, folder):
    """Losses of a network with a hidden layer until its validation loss stops falling."""
    t = _document_features(spark, folder)
    prepared = supervised.prepare_supervised_data(
        t, profile.profile_dataset(t, duplicates=False), "quality", key="doc_id",
        exclude_columns=["doc_id", "toxic"],
    )
    return perceptron.network_history(perceptron.fit_stopped_network(prepared, [8]), spark)


def _linear_network(spark, folder):
    t = load(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    prepared = supervised.prepare_supervised_data(
        t, profile.profile_dataset(t, duplicates=False), "c_mktsegment", key="c_custkey",
        exclude_columns=["c_custkey"],
    )
    return t, perceptron.fit_network(prepared)


@query
def network_weights(spark, folder):
    _, fitted = _linear_network(spark, folder)
    return perceptron.network_weights(fitted, spark)


@query
def network_largest_weights(spark, folder):
    _, fitted = _linear_network(spark, folder)
    return perceptron.largest_weights(fitted, spark)


@query
def network_predict(spark, folder):
    t, fitted = _linear_network(spark, folder)
    return perceptron.predict_network(fitted, t)


@query
def network_scores(spark, folder):
    """Every customer gets probabilities that sum to one, and the class of the largest."""
    t, fitted = _linear_network(spark, folder)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    names = F.array(*[F.lit(n) for n in fitted.class_names])
    scored = perceptron.predict_network(fitted, t)
    return scored.select(
        "c_custkey", F.round(total, 6).alias("total"),
        (F.col("prediction") == F.element_at(names, best)).alias("known_class"),
    )

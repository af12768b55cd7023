import math

import pytest
from pyspark.sql import functions as F

from tabulon.operators import profile
from tabulon.operators.distinct import distinct_counts


def test_row_and_column_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "age int, city string")
    p = profile.profile_dataset(df)
    assert (p.row_count, p.column_count, p.duplicate_rows) == (3, 2, 0)


def test_semantic_types(spark):
    df = spark.createDataFrame(
        [(1, "Rome", True, [1.0])], "age int, city string, active boolean, v array<double>"
    ).withColumns({"at": F.lit("2024-01-01").cast("timestamp"), "price": F.lit(1).cast("decimal(5,2)")})
    p = profile.profile_dataset(df)
    assert p.numeric_columns == ["age", "price"]
    assert p.categorical_columns == ["city"]
    assert p.boolean_columns == ["active"]
    assert p.datetime_columns == ["at"]
    assert p.other_columns == ["v"]


def test_missing_values_include_nan(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (float("nan"), None), (None, "b")], "age double, city string"
    )
    rows = {r["column_name"]: r for r in profile.profile_dataset(df).columns.collect()}
    assert rows["age"]["missing_count"] == 2
    assert rows["age"]["unique_count"] == 1
    assert rows["city"]["missing_percentage"] == pytest.approx(33.33)


def test_duplicates_treat_nulls_as_equal_but_positions_apart(spark):
    df = spark.createDataFrame(
        [(1, None), (1, None), (None, 1), (2, 2)], "a int, b int"
    )
    assert profile.count_duplicate_rows(df) == 1
    assert profile.profile_dataset(df).duplicate_rows == 1


def test_duplicate_row_fixture(spark):
    df = spark.createDataFrame([(20, "Rome"), (20, "Rome"), (30, "Oslo")], "age int, city string")
    assert profile.profile_dataset(df).duplicate_rows == 1


def test_text_detection(spark):
    long = "this product is really very good indeed"
    df = spark.createDataFrame(
        [(1, "IT", long), (2, "FR", long + " again"), (3, "DE", None)],
        "age int, country string, review string",
    )
    p = profile.profile_dataset(df)
    assert p.text_columns == ["review"] and p.categorical_columns == ["country"]
    row = p.columns.where("column_name = 'review'").first()
    assert row["average_words"] == 7.5 and row["max_words"] == 8
    assert profile.detect_text_columns(df, min_avg_words=20) == []


def test_all_missing_text_is_no_text(spark):
    df = spark.createDataFrame([(None,), (None,)], "note string")
    assert profile.detect_text_columns(df) == []


def test_approximate_profile(spark):
    df = spark.range(2000).selectExpr("id % 100 as k")
    p = profile.profile_dataset(df, approximate=True)
    assert p.columns.first()["unique_count"] == pytest.approx(100, rel=0.1)


def test_empty_table_and_errors(spark):
    p = profile.profile_dataset(spark.createDataFrame([], "a int"))
    assert p.row_count == 0 and p.columns.first()["missing_percentage"] is None
    with pytest.raises(ValueError):
        profile.profile_dataset(spark.createDataFrame([], ""))
    with pytest.raises(TypeError):
        profile.profile_dataset([1, 2])


def test_top_missing_order(spark):
    df = spark.createDataFrame([(None, None, 1), (1, None, 1)], "b int, a int, c int")
    rows = [tuple(r) for r in profile.top_missing(df, 2).collect()]
    assert rows == [("a", 2), ("b", 1)]


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert profile.profile_dataset(df).columns.first()["unique_count"] == 1
    assert not math.isnan(profile.profile_dataset(df).row_count)


def test_distinct_whole_numbers_and_dates_by_words_of_bits(spark):
    longs = [None, 0, -1, 1, 63, 64, -64, -65, 2**63 - 1, -(2**63), 2**63 - 2, 0, 64]
    rows = [(v, None if v is None else v % 2**31 - 2**30, None if v is None else v % 100 - 50) for v in longs]
    df = spark.createDataFrame(rows, "l long, i int, s short").withColumn("day", F.date_add(F.lit("1969-12-01").cast("date"), F.col("s")))
    got = distinct_counts(df, {c: F.col(c) for c in df.columns})
    assert got == {c: df.select(c).dropna().distinct().count() for c in df.columns}

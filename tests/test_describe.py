import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import describe, profile
from tabulon.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (20.0, "Sales", "this is a really very good review", "2024-01-01", True),
        (30.0, "Sales", "this is a really very bad review", "2024-01-03", False),
        (40.0, "IT", "I do not know what to say", "2024-01-05", True),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows, "age double, department string, review string, at string, active boolean"
    )
    return df.withColumn("created_at", F.col("at").cast("timestamp")).drop("at")


def one(df):
    return df.first().asDict()


def test_numeric(mixed):
    r = one(describe.numeric_statistics(mixed, ["age"]))
    assert (r["count"], r["missing_count"], r["unique_count"]) == (3, 1, 3)
    assert (r["mean"], r["median"], r["minimum"], r["maximum"]) == (30, 30, 20, 40)
    assert (r["first_quartile"], r["third_quartile"], r["standard_deviation"]) == (25, 35, 10)


def test_zeros_and_negatives(spark):
    df = spark.createDataFrame([(-5,), (0,), (10,), (0,)], "value int")
    r = one(describe.numeric_statistics(df, ["value"]))
    assert (r["zero_count"], r["negative_count"]) == (2, 1)


def test_all_missing_numeric(spark):
    df = spark.createDataFrame([(None,)] * 3, "score double")
    for approximate in (False, True):
        r = one(describe.numeric_statistics(df, ["score"], approximate))
        assert (r["count"], r["missing_count"], r["mean"], r["median"]) == (0, 3, None, None)
        assert (r["zero_count"], r["negative_count"]) == (0, 0)


def test_single_value_has_no_deviation(spark):
    r = one(describe.numeric_statistics(spark.createDataFrame([(7,)], "x int"), ["x"]))
    assert r["standard_deviation"] is None and r["median"] == 7


def test_text_numbers_are_coerced(spark):
    df = spark.createDataFrame([("1",), (" 2.5 ",), ("x",), ("1d",), ("3e1",), (None,)], "v string")
    r = one(describe.numeric_statistics(df, ["v"]))
    assert (r["count"], r["missing_count"], r["maximum"]) == (3, 1, 30)


def test_large_longs_stay_apart(spark):
    df = spark.createDataFrame([(2**60,), (2**60 + 1,)], "v long")
    assert one(describe.numeric_statistics(df, ["v"]))["unique_count"] == 2


def test_categorical(spark):
    df = spark.createDataFrame([(c,) for c in "AABBCD"], "category string")
    r = one(describe.categorical_statistics(df, ["category"], top_n=2))
    assert (r["count"], r["unique_count"], r["most_frequent"], r["most_frequent_count"]) == (6, 4, "A", 2)
    assert [tuple(v) for v in r["top_values"]] == [("A", 2), ("B", 2)]


def test_all_missing_categorical(spark):
    df = spark.createDataFrame([(None,), (None,)], "c string")
    r = one(describe.categorical_statistics(df, ["c"]))
    assert (r["count"], r["missing_count"], r["most_frequent"], r["most_frequent_count"]) == (0, 2, None, 0)


def test_text(spark):
    df = spark.createDataFrame([("good product here",), ("   ",), (" ok ",)], "comment string")
    r = one(describe.text_statistics(df, ["comment"]))
    assert (r["count"], r["empty_string_count"], r["unique_count"]) == (3, 1, 3)
    assert (r["minimum_words"], r["maximum_words"], r["average_words"]) == (1, 3, 2.0)
    assert (r["minimum_characters"], r["maximum_characters"]) == (2, 17)


def test_datetime(mixed, spark):
    r = one(describe.datetime_statistics(mixed, ["created_at"]))
    assert (r["count"], r["missing_count"], r["range_days"]) == (3, 1, 4)
    assert r["earliest"] == "2024-01-01T00:00:00"
    df = spark.createDataFrame([("2024-01-01",), ("soon",)], "d string")
    assert one(describe.datetime_statistics(df, ["d"]))["invalid_date_count"] == 1


def test_boolean(mixed, spark):
    r = one(describe.boolean_statistics(mixed, ["active"]))
    assert (r["true_count"], r["false_count"], r["true_percentage"]) == (2, 1, 66.67)
    r = one(describe.boolean_statistics(spark.createDataFrame([(None,)], "b boolean"), ["b"]))
    assert r["true_percentage"] is None


def test_sections_and_column_lookup(mixed):
    p = profile.profile_dataset(mixed)
    sections = describe.dataset_statistics(mixed, p)
    assert one(sections["dataset"])["row_count"] == 4
    assert sections["other"] is None
    assert [r["column_name"] for r in sections["text"].collect()] == ["review"]
    name, table = describe.column_statistics(mixed, "department", p)
    assert name == "categorical" and one(table)["most_frequent"] == "Sales"
    with pytest.raises(ValueError):
        describe.column_statistics(mixed, "nope", p)


def test_other(spark):
    df = spark.createDataFrame([([1],), ([1],), (None,)], "v array<int>")
    r = one(describe.other_statistics(df, ["v"]))
    assert (r["dtype"], r["count"], r["missing_count"], r["unique_count"]) == ("array<int>", 2, 1, 1)


@pytest.mark.parametrize("max_rows", [40, 1_000_000])
def test_exact_quantiles_match_numpy(spark, max_rows):
    """The narrowing passes (forced by a small limit) give the same values as one sort."""
    rng = random.Random(5)
    data = [(rng.choice([7.0, rng.gauss(0, 1), -1e9 if rng.random() < 0.05 else 3.0]),) for _ in range(3000)]
    df = spark.createDataFrame(data, "x double")
    wanted = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, {"x": F.col("x")}, wanted, max_rows=max_rows)["x"]
    assert got == pytest.approx(list(np.quantile([d[0] for d in data], wanted)), rel=1e-12)

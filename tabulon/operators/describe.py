"""Descriptive statistics, one function per semantic type, tidy output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import text as tx
from tabulon.functions import values as vx
from tabulon.operators.distinct import distinct_counts
from tabulon.operators.profile import Profile
from tabulon.operators.quantiles import exact_quantiles

NUMERIC_SCHEMA = (
    "column_name string, count long, missing_count long, unique_count long, mean double, "
    "standard_deviation double, minimum double, first_quartile double, median double, "
    "third_quartile double, maximum double, zero_count long, negative_count long"
)


def _describe(df: DataFrame, columns: Sequence[str], figures, keys, schema: str) -> DataFrame:
    """One row per column from one plain aggregate and one distinct count.

    ``figures(column)`` maps output names to aggregates, ``keys(column)`` gives the value
    whose distinct count becomes ``unique_count``. Only finished figures reach the driver.
    """
    vx.require_columns(df, columns)
    names = schema.replace(",", "").split()[0::2]
    wide = []
    for i, column in enumerate(columns):
        wide += [e.alias(f"{name}_{i}") for name, e in figures(column).items()]
    row = df.agg(*wide).first().asDict()
    for i, n in enumerate(distinct_counts(df, {c: keys(c) for c in columns}).values()):
        row[f"unique_count_{i}"] = n
    lines = [
        [c, *[row[f"{name}_{i}"] for name in names[1:]]] for i, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(lines, schema)


def numeric_statistics(
    df: DataFrame, columns: Sequence[str], approximate: bool = False
) -> DataFrame:
    """Moments, range and exact quartiles. ``approximate`` uses sketches for the distinct
    count and the quartiles and then needs a single pass."""
    vx.require_columns(df, columns)
    numbers = {c: vx.to_number(df, c) for c in columns}
    aggregates, keys = [F.count(F.lit(1)).alias("rows")], {}
    for i, c in enumerate(columns):
        x = numbers[c]
        # Whole numbers are told apart as such: a double cannot hold every long.
        kind = vx.field_of(df, c).dataType
        key = vx.ref(c) if isinstance(kind, (T.IntegralType, T.DecimalType)) else x
        keys[c] = key
        aggregates += [
            F.count(x).alias(f"count{i}"),
            F.count(vx.present(df, c)).alias(f"raw{i}"),
            *([F.approx_count_distinct(key).alias(f"unique{i}")] if approximate else []),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
            F.count_if(x == 0).alias(f"zero{i}"),
            F.count_if(x < 0).alias(f"negative{i}"),
        ]
        if approximate:
            aggregates.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}"))
    row = df.agg(*aggregates).first()
    if approximate:
        quartiles = {c: row[f"q{i}"] or [None] * 3 for i, c in enumerate(columns)}
        unique = {c: row[f"unique{i}"] for i, c in enumerate(columns)}
    else:
        known = {
            c: (row[f"count{i}"], row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(columns)
        }
        quartiles = exact_quantiles(df, numbers, [0.25, 0.5, 0.75], known)
        unique = distinct_counts(df, keys)
    lines = []
    for i, c in enumerate(columns):
        q1, median, q3 = quartiles[c]
        lines.append(
            (
                c, row[f"count{i}"], row["rows"] - row[f"raw{i}"], unique[c],
                row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"], q1, median, q3,
                row[f"max{i}"], row[f"zero{i}"], row[f"negative{i}"],
            )
        )
    return df.sparkSession.createDataFrame(lines, NUMERIC_SCHEMA)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) for all columns from one shuffle; missing is value NULL."""
    vx.require_columns(df, columns)
    cells = [
        F.struct(F.lit(c).alias("column_name"), vx.present(df, c).cast("string").alias("value"))
        for c in columns
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
    )


def top_values(df: DataFrame, columns: Sequence[str], top_n: int = 10) -> DataFrame:
    """The most frequent values per column with their place; ties by value ascending."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return (
        value_counts(df, columns)
        .where(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top_n)
        .select("column_name", "place", "value", F.col("n").alias("frequency"))
    )


def categorical_statistics(df: DataFrame, columns: Sequence[str], top_n: int = 10) -> DataFrame:
    """Counts per column, its most frequent value and its ``top_n`` values as an array."""
    freq = value_counts(df, columns)
    totals = freq.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count("value").alias("unique_count"),
    )
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    top = (
        freq.where(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top_n)
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value", F.col("n").alias("frequency")))).alias("top"))
    )
    return totals.join(top, "column_name", "left").select(
        *totals.columns,
        F.get(F.col("top.value"), F.lit(0)).alias("most_frequent"),
        F.coalesce(F.get(F.col("top.frequency"), F.lit(0)), F.lit(0)).alias("most_frequent_count"),
        F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["frequency"].alias("frequency"))).alias("top_values"),
    )


def text_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lengths over the stripped non-blank texts; blank texts are counted apart."""
    vx.require_columns(df, columns)
    stripped = df.select(*[tx.strip(vx.present(df, c).cast("string")).alias(c) for c in columns])
    # Named once, so that the aggregates share one count of words per row.
    measured = stripped.withColumns(
        {
            f"{tag}_{i}": F.when(vx.ref(c) != "", measure(vx.ref(c)))
            for i, c in enumerate(columns)
            for tag, measure in (("_words", tx.word_count), ("_chars", tx.char_count))
        }
    )
    place = {c: i for i, c in enumerate(columns)}

    def figures(c):
        text, words, chars = vx.ref(c), F.col(f"_words_{place[c]}"), F.col(f"_chars_{place[c]}")
        return {
            "count": F.count(text),
            "missing_count": F.count_if(text.isNull()),
            "empty_string_count": F.count_if(text == ""),
            "average_words": F.avg(words),
            "minimum_words": F.min(words),
            "maximum_words": F.max(words),
            "average_characters": F.avg(chars),
            "minimum_characters": F.min(chars),
            "maximum_characters": F.max(chars),
        }

    return _describe(
        measured, columns, figures, vx.ref,
        "column_name string, count long, missing_count long, unique_count long, "
        "empty_string_count long, average_words double, minimum_words int, "
        "maximum_words int, average_characters double, minimum_characters int, "
        "maximum_characters int",
    )


def _iso(t):
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(t, "SSSSSS") == "000000", base).otherwise(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def datetime_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Earliest and latest moment (ISO text) and the whole days between them."""

    def figures(c):
        t = vx.to_time(df, c)
        return {
            "count": F.count(t),
            "missing_count": F.count_if(vx.is_missing(df, c)),
            "invalid_date_count": F.count_if(t.isNull() & ~vx.is_missing(df, c)),
            "earliest": _iso(F.min(t)),
            "latest": _iso(F.max(t)),
            "range_days": F.timestamp_diff("DAY", F.min(t), F.max(t)),
        }

    return _describe(
        df, columns, figures, lambda c: vx.to_time(df, c),
        "column_name string, count long, missing_count long, invalid_date_count long, "
        "unique_count long, earliest string, latest string, range_days long",
    )


def boolean_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    vx.require_columns(df, columns)
    cells = [
        F.struct(F.lit(c).alias("column_name"), vx.ref(c).alias("b")) for c in columns
    ]
    share = lambda n: F.round(F.col(n) / F.nullif(F.col("count"), F.lit(0)) * 100, 2)
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column_name")
        .agg(
            F.count("b").alias("count"),
            F.count_if(F.col("b").isNull()).alias("missing_count"),
            F.count_if(F.col("b")).alias("true_count"),
            F.count_if(~F.col("b")).alias("false_count"),
        )
        .withColumn("true_percentage", share("true_count"))
        .withColumn("false_percentage", share("false_count"))
    )


def other_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts for the columns no other section covers."""

    def figures(c):
        value = vx.comparable(df, c)
        return {
            "dtype": F.max(F.lit(vx.field_of(df, c).dataType.simpleString())),
            "count": F.count(value),
            "missing_count": F.count_if(value.isNull()),
        }

    return _describe(
        df, columns, figures, lambda c: vx.comparable(df, c),
        "column_name string, dtype string, count long, missing_count long, unique_count long",
    )


SECTIONS = {
    "numeric": numeric_statistics,
    "categorical": categorical_statistics,
    "text": text_statistics,
    "datetime": datetime_statistics,
    "boolean": boolean_statistics,
    "other": other_statistics,
}


def dataset_statistics(df: DataFrame, profile: Profile) -> dict[str, DataFrame | None]:
    """One DataFrame per semantic type present, plus the ``dataset`` row.

    Columns the profile does not know are described as ``other``.
    """
    known = {
        "numeric": profile.numeric_columns,
        "categorical": profile.categorical_columns,
        "text": profile.text_columns,
        "datetime": profile.datetime_columns,
        "boolean": profile.boolean_columns,
    }
    seen = {c for columns in known.values() for c in columns}
    known["other"] = [c for c in df.columns if c not in seen]
    result: dict[str, DataFrame | None] = {
        "dataset": df.sparkSession.createDataFrame(
            [(profile.row_count, profile.column_count, profile.duplicate_rows)],
            "row_count long, column_count int, duplicate_rows long",
        )
    }
    for section, describe in SECTIONS.items():
        result[section] = describe(df, known[section]) if known[section] else None
    return result


def column_statistics(df: DataFrame, column: str, profile: Profile) -> tuple[str, DataFrame]:
    """Section name and statistics of one column, computed from that column alone."""
    vx.require_columns(df, [column])
    narrow = vx.select_columns(df, [column])
    for section, columns in (
        ("numeric", profile.numeric_columns),
        ("categorical", profile.categorical_columns),
        ("text", profile.text_columns),
        ("datetime", profile.datetime_columns),
        ("boolean", profile.boolean_columns),
    ):
        if column in columns:
            return section, SECTIONS[section](narrow, [column])
    return "other", other_statistics(narrow, [column])

"""Profiles that grow with new files: one mergeable state per file and column.

A state holds counts, moments, extremes and two of Spark's sketches (HLL for distinct
values, KLL for quantiles). Adding files to a table reads those files only; a profile is a
merge of states and reads no data. Counts, means, deviations and extremes are exact, the
sketches' figures carry their error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import text as tx
from tabulon.functions import values as vx
from tabulon.operators.profile import MIN_AVERAGE_WORDS

#: A distinct sketch has 2 ** 12 registers of a byte, a quantile sketch keeps a few hundred values.
LOG_REGISTERS = 12
QUANTILE_SIZE = 200
#: Relative standard error of the distinct counts; error of a quantile's rank at 99 % confidence.
DISTINCT_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
RANK_ERROR = 2.296 / QUANTILE_SIZE**0.9021

FILE = ["file", "modified", "length"]
STATE_SCHEMA = (
    "file string, modified timestamp, length long, rows long, position int, column_name string, dtype string, "
    "present long, words long, chars long, max_words int, numbers long, mean double, spread double, "
    "low double, high double, distinct_sketch binary, quantile_sketch binary"
)


def table_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, length) of the files of a table; their contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(
        F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length")
    )


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _all_states(spark: SparkSession, states: str) -> DataFrame:
    system, place = _place(spark, states)
    if not system.exists(place):
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(states)


def _column_state(df: DataFrame, position: int, field: T.StructField) -> tuple[list[Column], Column]:
    """(aggregates, the struct of a state built from them) of one column."""
    value, i = vx.present(df, field.name), position
    compared = vx.comparable(df, field.name)
    hashed = F.when(compared.isNotNull(), F.xxhash64(compared))
    aggregates = [
        F.count(value).alias(f"n{i}"), F.hll_sketch_agg(hashed, LOG_REGISTERS).alias(f"u{i}"),
    ]
    missing = {
        "words": "long", "chars": "long", "max_words": "int", "numbers": "long", "mean": "double",
        "spread": "double", "low": "double", "high": "double", "quantile_sketch": "binary",
    }
    held = {name: F.lit(None).cast(kind) for name, kind in missing.items()}
    if isinstance(field.dataType, T.StringType):
        words = tx.word_count(value)
        aggregates += [
            F.sum(words).alias(f"w{i}"), F.max(words).alias(f"x{i}"), F.sum(tx.char_count(value)).alias(f"c{i}"),
        ]
        held |= {"words": F.col(f"w{i}"), "chars": F.col(f"c{i}"), "max_words": F.col(f"x{i}")}
    elif isinstance(field.dataType, T.NumericType):
        number = value.cast("double")
        aggregates += [
            F.avg(number).alias(f"m{i}"), F.var_pop(number).alias(f"v{i}"), F.min(number).alias(f"l{i}"),
            F.max(number).alias(f"h{i}"), F.kll_sketch_agg_double(number, F.lit(QUANTILE_SIZE)).alias(f"q{i}"),
        ]
        some = F.col(f"n{i}") > 0
        held |= {
            "numbers": F.col(f"n{i}"), "mean": F.col(f"m{i}"), "spread": F.col(f"v{i}") * F.col(f"n{i}"),
            "low": F.col(f"l{i}"), "high": F.col(f"h{i}"), "quantile_sketch": F.when(some, F.col(f"q{i}")),
        }
    state = F.struct(
        F.lit(i).alias("position"), F.lit(field.name).alias("column_name"),
        F.lit(field.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("present"),
        *[held[n].alias(n) for n in missing if n != "quantile_sketch"],
        F.col(f"u{i}").alias("distinct_sketch"), held["quantile_sketch"].alias("quantile_sketch"),
    )
    return aggregates, state


def update_states(spark: SparkSession, path: str, states: str) -> int:
    """Add the states of a Parquet table's new or changed files; the number of files read.

    A file counts as changed when its time or length does. A failed run adds nothing, as
    Spark commits the new states as a whole. The driver lists the new files' names, as a
    read of them does anyway. A file without rows has a state of no rows.
    """
    files = table_files(spark, path)
    known = _all_states(spark, states).select(*FILE).distinct()
    new = files.join(known, FILE, "left_anti").collect()
    if not new:
        return 0
    reader = spark.read.schema(spark.read.parquet(path).schema)
    system, place = _place(spark, path)
    if system.getFileStatus(place).isDirectory():
        reader = reader.option("basePath", path)  # for the columns that folder names hold
    rows = reader.parquet(*[r["file"] for r in new])
    built = [_column_state(rows, i, f) for i, f in enumerate(rows.schema.fields)]
    source = F.col("_metadata")
    grouped = rows.groupBy(source["file_path"].alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), *[a for aggregates, _ in built for a in aggregates]
    )
    # Files without rows give no group, but must be known too.
    listed = spark.createDataFrame(new, files.schema)
    found = listed.join(grouped, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    cells = found.select(*FILE, "rows", F.inline(F.array(*[state for _, state in built])))
    cells = cells.withColumn("present", F.coalesce("present", F.lit(0).cast("long")))
    cells.select(*[c.split()[0] for c in STATE_SCHEMA.split(", ")]).write.mode("append").parquet(states)
    return len(new)


def current_states(spark: SparkSession, path: str, states: str) -> DataFrame:
    """The states of the files that the table has now, each once."""
    held = _all_states(spark, states).join(table_files(spark, path), FILE, "left_semi")
    return held.dropDuplicates([*FILE, "column_name"])


def merged_profile(
    current: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), min_avg_words: float = MIN_AVERAGE_WORDS
) -> DataFrame:
    """One row per column from states alone, in the order of the columns.

    Exact: ``row_count``, ``missing_count``, word and character figures, ``minimum``,
    ``maximum``, ``mean``, ``standard_deviation`` (sample). Estimated: ``unique_estimate``
    (relative standard error ``unique_error``) and ``quantiles`` (values whose rank is off by at
    most ``rank_error``, with 99 % confidence). A column that a file lacks is missing there.
    """
    total = current.select(*FILE, "rows").distinct().agg(F.sum("rows")).first()[0] or 0
    numbers = F.coalesce(F.sum("numbers"), F.lit(0))
    merged = current.groupBy("column_name").agg(
        F.max("position").alias("position"), F.max_by("dtype", "modified").alias("dtype"),
        F.sum("present").alias("present"), F.sum("words").alias("words"), F.sum("chars").alias("chars"),
        F.max("max_words").alias("max_words"), numbers.alias("numbers"),
        (F.sum(F.col("mean") * F.col("numbers")) / F.nullif(numbers, F.lit(0))).alias("mean"),
        F.min("low").alias("minimum"), F.max("high").alias("maximum"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("unique_estimate"),
        F.kll_merge_agg_double("quantile_sketch").alias("sketch"),
    )
    # Squares about the common mean, so that nothing cancels. One row per column is joined.
    about = current.select("column_name", "numbers", "spread", F.col("mean").alias("own")).join(
        merged.select("column_name", "mean"), "column_name"
    )
    squares = about.groupBy("column_name").agg(
        F.sum(F.col("spread") + F.col("numbers") * F.pow(F.col("own") - F.col("mean"), F.lit(2))).alias("squares")
    )
    average = F.col("words") / F.nullif(F.col("present"), F.lit(0))
    numeric = F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    kind = (
        F.when((F.col("dtype") == "string") & (average >= min_avg_words), "text").when(F.col("dtype") == "string", "categorical")
        .when(numeric, "numeric").when(F.col("dtype") == "boolean", "boolean")
        .when(F.col("dtype").rlike("^(date|timestamp.*)$"), "datetime").otherwise("other")
    )
    in_text = kind == "text"
    asked = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in quantiles])
    return (
        merged.join(squares, "column_name")
        .select(
            "position", "column_name", "dtype", kind.alias("column_type"), F.lit(total).cast("long").alias("row_count"),
            (F.lit(total) - F.col("present")).alias("missing_count"),
            F.when(in_text, F.round(average, 2)).alias("average_words"), F.when(in_text, F.col("max_words")).alias("max_words"),
            F.when(in_text, F.round(F.col("chars") / F.col("present"), 2)).alias("average_characters"),
            "minimum", "maximum", "mean",
            F.when(F.col("numbers") > 1, F.sqrt(F.col("squares") / (F.col("numbers") - 1))).alias("standard_deviation"),
            "unique_estimate", F.lit(DISTINCT_ERROR).alias("unique_error"),
            F.when(F.col("numbers") > 0, asked).alias("quantiles"), F.lit(RANK_ERROR).alias("rank_error"),
        )
        .orderBy("position")
    )


def incremental_profile(
    spark: SparkSession, path: str, states: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75), min_avg_words: float = MIN_AVERAGE_WORDS
) -> DataFrame:
    """The profile of a Parquet table, reading only files that ``states`` does not know yet."""
    update_states(spark, path, states)
    return merged_profile(current_states(spark, path, states), quantiles, min_avg_words)

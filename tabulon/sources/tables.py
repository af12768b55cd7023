"""Reading tables: format by suffix, missing tokens, inferred types."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.values import NUMBER, ref

SUPPORTED = (".csv", ".parquet")

# The texts a CSV reader takes for a missing cell.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER = r"^\s*[+-]?\d+\s*$"
# Digits that a double holds without loss.
EXACT_DIGITS = r"^\s*[+-]?0*\d{1,15}\s*$"


def get_file_extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def validate_file_type(path: str) -> str:
    """The lower-case suffix; ValueError with the supported ones for any other."""
    extension = get_file_extension(path)
    if extension not in SUPPORTED:
        raise ValueError(
            f"Unsupported file type '{extension}'. Supported: {', '.join(sorted(SUPPORTED))}"
        )
    return extension


def get_dataset_name(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def with_dataset_name(df: DataFrame, column: str = "dataset_name") -> DataFrame:
    """Add the stem of the file each row came from."""
    return df.withColumn(column, F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def missing_tokens_to_null(df: DataFrame) -> DataFrame:
    """String cells that spell a missing value become NULL."""
    return df.select(
        *[
            F.when(~ref(name).isin(*MISSING_TOKENS), ref(name)).alias(name)
            if kind == "string"
            else ref(name)
            for name, kind in df.dtypes
        ]
    )


def infer_types(df: DataFrame, datetimes: bool = False) -> DataFrame:
    """Give string columns the narrowest type that holds every present value.

    One aggregate checks all columns. Date and time texts stay strings unless
    ``datetimes`` is set.
    """
    texts = [name for name, kind in df.dtypes if kind == "string"]
    if not texts:
        return df

    def rules(c: Column) -> dict[str, Column]:
        found = {
            "boolean": F.lower(c).isin("true", "false"),
            "bigint": F.when(c.isNotNull(), F.regexp_like(c, F.lit(INTEGER)) & F.trim(c).try_cast("bigint").isNotNull()),
            # A long integer would lose digits as a double; such a column stays text.
            "double": F.regexp_like(c, F.lit(NUMBER))
            & (~F.regexp_like(c, F.lit(INTEGER)) | F.regexp_like(c, F.lit(EXACT_DIGITS))),
        }
        if datetimes:
            found["timestamp"] = F.when(c.isNotNull(), c.try_cast("timestamp").isNotNull())
        return found

    checks = [F.count(ref(name)).alias(f"n{i}") for i, name in enumerate(texts)]
    for i, name in enumerate(texts):
        checks += [F.bool_and(rule).alias(f"{kind}{i}") for kind, rule in rules(ref(name)).items()]
    row = df.agg(*checks).first()
    kinds = {}
    for i, name in enumerate(texts):
        if not row[f"n{i}"]:
            kinds[name] = "double"  # nothing but missing cells
            continue
        fitting = [kind for kind in rules(ref(name)) if row[f"{kind}{i}"]]
        if fitting:
            kinds[name] = fitting[0]
    return df.select(
        *[
            F.trim(ref(name)).try_cast(kinds[name]).alias(name) if name in kinds else ref(name)
            for name in df.columns
        ]
    )


def read_csv(
    spark: SparkSession, path: str, datetimes: bool = False, schema=None, multiline: bool = False
) -> DataFrame:
    """CSV with a header row. A given ``schema`` spares the pass that infers types.

    Spark splits large files. Set ``multiline`` for files whose quoted cells hold line
    breaks; each of them is then one task's work.
    """
    reader = (
        spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    )
    if schema is not None:
        return reader.schema(schema).csv(path)
    return infer_types(missing_tokens_to_null(reader.csv(path)), datetimes)


def read_table(
    spark: SparkSession, path: str, datetimes: bool = False, schema=None, multiline: bool = False
) -> DataFrame:
    """Read a file, folder or glob by its suffix."""
    extension = validate_file_type(path)
    try:
        if extension == ".csv":
            df = read_csv(spark, path, datetimes, schema, multiline)
        else:
            df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() and "UNABLE_TO_INFER_SCHEMA" in error.getCondition():
            raise ValueError("The dataset is empty.") from error
        raise RuntimeError(f"The dataset could not be read: {error}") from error
    if not df.columns:
        raise ValueError("The dataset is empty.")
    return df


def preview(df: DataFrame, rows: int = 10, order_by: str | None = None) -> DataFrame:
    """The first rows; only with ``order_by`` are they always the same ones."""
    return (df.orderBy(ref(order_by)) if order_by else df).limit(rows)

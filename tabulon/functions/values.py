"""Missing values, coercion and semantic type of a Spark type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = (
    r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
)


def field_of(df: DataFrame, column: str) -> T.StructField:
    return next(f for f in df.schema.fields if f.name == column)


def ref(column: str) -> Column:
    """Reference a column by its exact name, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def require_columns(df: DataFrame, columns) -> None:
    for column in columns:
        if column not in df.columns:
            raise ValueError(f"Column '{column}' does not exist.")


def select_columns(df: DataFrame, columns) -> DataFrame:
    require_columns(df, columns)
    return df.select(*[ref(c) for c in columns])


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN read as missing, as NULL already is."""
    if isinstance(field_of(df, column).dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(ref(column), F.lit(None).cast("double"))
    return ref(column)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def is_missing(df: DataFrame, column: str) -> Column:
    return present(df, column).isNull()


def drop_missing_pair(df: DataFrame, first: str, second: str) -> DataFrame:
    """Keep the rows in which both columns are present."""
    return select_columns(df, [first, second]).dropna()


def to_number(df: DataFrame, column: str) -> Column:
    """The column as DOUBLE; values that are no number become NULL."""
    kind = field_of(df, column).dataType
    if isinstance(kind, T.NumericType):
        return present(df, column).cast("double")
    if isinstance(kind, T.BooleanType):
        return ref(column).cast("int").cast("double")
    if isinstance(kind, T.StringType):
        text = ref(column)
        return F.when(F.regexp_like(text, F.lit(NUMBER)), F.trim(text).try_cast("double"))
    return F.lit(None).cast("double")


def to_time(df: DataFrame, column: str) -> Column:
    """The column as TIMESTAMP; values that are no time become NULL."""
    kind = field_of(df, column).dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return ref(column)
    if isinstance(kind, (T.DateType, T.StringType)):
        return ref(column).try_cast("timestamp")
    return F.lit(None).cast("timestamp")


def semantic_type(kind: T.DataType, average_words: float | None, min_avg_words: float) -> str:
    if isinstance(kind, T.StringType):
        is_text = average_words is not None and average_words >= min_avg_words
        return "text" if is_text else "categorical"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def comparable(df: DataFrame, column: str) -> Column:
    """A value that distinct counts can group on.

    Arrays, structs and maps are written out as JSON with their NULLs, since hash functions
    skip NULLs inside them.
    """
    kind = field_of(df, column).dataType
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        written = F.to_json(F.struct(ref(column).alias("v")), {"ignoreNullFields": "false"})
        return F.when(ref(column).isNotNull(), written)
    return present(df, column)


def row_key(df: DataFrame) -> Column:
    """All values of a row as one struct, its NULL pattern first.

    Hash functions skip NULLs, so without the pattern (NULL, 1) and (1, NULL) would hash
    alike.
    """
    values = [comparable(df, c) for c in df.columns]
    return F.struct(
        *[v.isNull().alias(f"m{i}") for i, v in enumerate(values)],
        *[v.alias(f"v{i}") for i, v in enumerate(values)],
    )

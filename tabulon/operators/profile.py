"""Column profiles: counts, missing values, distinct values and semantic types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import text as tx
from tabulon.functions import values as vx
from tabulon.operators.distinct import distinct_counts

MIN_AVERAGE_WORDS = 6.0


@dataclass(frozen=True)
class Profile:
    """What is known of a table; ``columns`` is the tidy form, one row per column."""

    row_count: int
    column_count: int
    duplicate_rows: int | None
    numeric_columns: list[str]
    categorical_columns: list[str]
    boolean_columns: list[str]
    text_columns: list[str]
    datetime_columns: list[str]
    other_columns: list[str]
    columns: DataFrame


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def detect_text_columns(
    df: DataFrame, min_avg_words: float = MIN_AVERAGE_WORDS
) -> list[str]:
    """String columns whose present values have at least this many words on average."""
    names = _strings(df)
    if not names:
        return []
    row = df.agg(
        *[F.avg(tx.word_count(vx.ref(c))).alias(f"w{i}") for i, c in enumerate(names)]
    ).first()
    means = [row[f"w{i}"] for i in range(len(names))]
    return [c for c, m in zip(names, means, strict=True) if m is not None and m >= min_avg_words]


def count_duplicate_rows(df: DataFrame) -> int:
    """Rows that repeat an earlier row; NULLs count as equal."""
    return df.count() - distinct_counts(df, {"rows": vx.row_key(df)})["rows"]


def column_profiles(
    df: DataFrame,
    min_avg_words: float = MIN_AVERAGE_WORDS,
    approximate: bool = False,
    duplicates: bool = True,
) -> tuple[dict, list[dict]]:
    """The figures behind :func:`profile_dataset`, from one plain aggregate and one distinct count."""
    if not isinstance(df, DataFrame):
        raise TypeError("A Spark DataFrame is needed.")
    if not df.columns:
        raise ValueError("A table without columns has no profile.")
    fields = df.schema.fields
    total = F.count(F.lit(1)).alias("total")

    aggregates = [total]
    for i, f in enumerate(fields):
        aggregates.append(F.count(vx.present(df, f.name)).alias(f"n{i}"))
        if isinstance(f.dataType, T.StringType):
            words = tx.word_count(vx.ref(f.name))
            chars = tx.char_count(vx.ref(f.name))
            aggregates += [
                F.avg(words).alias(f"w{i}"),
                F.max(words).alias(f"x{i}"),
                F.avg(chars).alias(f"c{i}"),
            ]
    keys = {f"u{i}": vx.comparable(df, f.name) for i, f in enumerate(fields)}
    if duplicates:
        keys["rows"] = vx.row_key(df)
    if approximate:
        aggregates += [
            F.approx_count_distinct(F.xxhash64(k) if n == "rows" else k).alias(n)
            for n, k in keys.items()
        ]
    row = df.agg(*aggregates).first()
    unique = row if approximate else distinct_counts(df, keys)

    total = row["total"]
    head = {
        "row_count": total,
        "column_count": len(fields),
        "duplicate_rows": max(0, total - unique["rows"]) if duplicates else None,
    }
    lines = []
    for i, f in enumerate(fields):
        is_string = isinstance(f.dataType, T.StringType)
        kind = vx.semantic_type(f.dataType, row[f"w{i}"] if is_string else None, min_avg_words)
        missing = total - row[f"n{i}"]
        in_text = kind == "text"
        lines.append(
            {
                "position": i,
                "column_name": f.name,
                "dtype": f.dataType.simpleString(),
                "column_type": kind,
                "missing_count": missing,
                "missing_percentage": round(missing / total * 100, 2) if total else None,
                "unique_count": unique[f"u{i}"],
                "average_words": round(row[f"w{i}"], 2) if in_text else None,
                "max_words": int(row[f"x{i}"]) if in_text else None,
                "average_characters": round(row[f"c{i}"], 2) if in_text else None,
            }
        )
    return head, lines


PROFILE_SCHEMA = (
    "position int, column_name string, dtype string, column_type string, "
    "missing_count long, missing_percentage double, unique_count long, "
    "average_words double, max_words int, average_characters double"
)


def profile_dataset(
    df: DataFrame,
    min_avg_words: float = MIN_AVERAGE_WORDS,
    approximate: bool = False,
    duplicates: bool = True,
) -> Profile:
    """Profile every column in two passes; ``approximate`` swaps the exact distinct counts
    for sketches, which needs one pass and no shuffle of values."""
    head, lines = column_profiles(df, min_avg_words, approximate, duplicates)

    def named(kind):
        return [line["column_name"] for line in lines if line["column_type"] == kind]

    return Profile(
        **head,
        numeric_columns=named("numeric"),
        categorical_columns=named("categorical"),
        boolean_columns=named("boolean"),
        text_columns=named("text"),
        datetime_columns=named("datetime"),
        other_columns=named("other"),
        columns=df.sparkSession.createDataFrame(
            [tuple(line.values()) for line in lines], PROFILE_SCHEMA
        ),
    )


def total_missing_cells(profile: Profile) -> DataFrame:
    return profile.columns.agg(F.sum("missing_count").alias("total_missing_cells"))


def top_missing(df: DataFrame, limit: int = 30) -> DataFrame:
    """Columns with the most missing values first, names ascending on ties."""
    counts = df.agg(
        *[F.count_if(vx.is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"))
        for i, c in enumerate(df.columns)
    ]
    return (
        counts.select(F.inline(F.array(*cells)))
        .orderBy(F.desc("missing_count"), "column_name")
        .limit(limit)
    )


def testable_columns(profile: Profile) -> DataFrame:
    """Columns fit for two-group tests (exactly two values) or multi-group tests (three or more)."""
    fit = (
        F.when(F.col("unique_count") == 2, "binary")
        .when(F.col("unique_count") >= 3, "multi_group")
    )
    return (
        profile.columns.where(F.col("column_type").isin("categorical", "boolean"))
        .select("column_name", "column_type", "unique_count", fit.alias("candidate"))
        .where(F.col("candidate").isNotNull())
    )

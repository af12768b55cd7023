"""Distinct counts of many columns from one narrow shuffle.

``count_distinct`` over k columns makes Spark expand every row into k rows that are k
columns wide. Here each value travels as (column number, 64 or 128 bit key) instead, and
repeats collapse before the shuffle. Whole numbers and dates travel 64 to a word: a row
says which word and which bit, words are OR-ed on both sides of the shuffle and their bits
counted, so dense ids shrink by up to 64 and sparse ones cost what a key would.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hashing one value of these types is a bijection on its bits, so 64 bits are exact.
FIXED_WIDTH = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
)
# Neighbouring values of these types are often both present.
COUNTED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def distinct_counts(df: DataFrame, exprs: Mapping[str, Column]) -> dict[str, int]:
    """Number of distinct non-NULL values per expression.

    Values of variable width are told apart by 128 bits from two hash seeds.
    """
    names = list(exprs)
    if not names:
        return {}
    narrow = df.select(*[exprs[n].alias(f"v{i}") for i, n in enumerate(names)])
    cells = []
    for i, f in enumerate(narrow.schema.fields):
        value = F.col(f.name)
        if isinstance(f.dataType, COUNTED):
            number = (F.unix_date(value) if isinstance(f.dataType, T.DateType) else value).cast("long")
            first, second = F.shiftright(number, 6), F.lit(0).cast("long")
            bits = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63).cast("long")).cast("int"))
        else:
            exact = isinstance(f.dataType, FIXED_WIDTH)
            first = F.when(value.isNotNull(), F.xxhash64(F.lit(1), value))
            second = F.lit(0).cast("long") if exact else F.xxhash64(F.lit(2), value)
            bits = F.lit(1).cast("long")
        cells.append(F.struct(F.lit(i).alias("part"), first.alias("a"), second.alias("b"), bits.alias("bits")))
    rows = (
        narrow.select(F.inline(F.array(*cells)))
        .where(F.col("a").isNotNull())
        .groupBy("part", "a", "b")
        .agg(F.bit_or("bits").alias("bits"))
        .groupBy("part")
        .agg(F.sum(F.bit_count("bits")).alias("n"))
        .collect()
    )
    counted = {r["part"]: r["n"] for r in rows}
    return {n: counted.get(i, 0) for i, n in enumerate(names)}

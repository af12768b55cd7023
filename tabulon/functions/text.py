"""Column expressions on text. All of them stay on the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as a Unicode string split sees it (as a list and as a pattern
# class), and the token pattern (runs of two or more letters, digits or underscores).
SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?U){NOT_SPACE}+"))


def char_count(text: Column) -> Column:
    return F.char_length(text)


def clean(text: Column) -> Column:
    """Lower case, outer whitespace removed, inner whitespace runs collapsed."""
    return strip(F.regexp_replace(F.lower(text), f"(?U){SPACE}+", " "))


def tokens(text: Column) -> Column:
    """Lower-case tokens in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def without_stop_words(df: DataFrame, words: str, stop_words: Sequence[str]) -> DataFrame:
    """Drop stop words from an array of tokens, in MLlib's compiled filter."""
    if not stop_words:
        return df
    remover = StopWordsRemover(inputCol=words, outputCol="_kept", stopWords=list(stop_words), caseSensitive=True)
    return remover.transform(df).withColumn(words, F.col("_kept")).drop("_kept")


def with_ngrams(df: DataFrame, words: str, n: int, name: str) -> DataFrame:
    """Every run of n neighbouring words joined by one space."""
    return NGram(n=n, inputCol=words, outputCol=name).transform(df)

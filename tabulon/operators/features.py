"""Imputation, scaling and one-hot encoding as a savable MLlib pipeline.

The fitted figures (a few numbers per numeric column, a bounded list per categorical
column) become literals of the pipeline, so applying it is a projection without shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import values as vx
from tabulon.operators.distinct import distinct_counts
from tabulon.operators.quantiles import exact_quantiles

SCALINGS = ("standard", "robust", "minmax", "none")
MAX_CATEGORIES = 10_000


@dataclass(frozen=True)
class FittedFeatures:
    """``model`` adds a ``features`` vector; the other fields say what is in it."""

    model: PipelineModel
    feature_names: list[str]
    numeric_columns: list[str]
    categorical_columns: list[str]


def check_scaling(scaling: str | None) -> str:
    name = "none" if scaling is None else str(scaling).lower()
    if name not in SCALINGS:
        raise ValueError(f"Unsupported scaling '{scaling}'; use one of {', '.join(SCALINGS)}.")
    return name


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _number_sql(column: str) -> str:
    return f"nanvl(try_cast({_quoted(column)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def _category_sql(df: DataFrame, column: str) -> str:
    text = f"CAST({_quoted(column)} AS STRING)"
    if isinstance(vx.field_of(df, column).dataType, (T.FloatType, T.DoubleType)):
        return f"nullif({text}, 'NaN')"
    return text


def _text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feature_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """What is fitted of each column: its number, or its text; null where missing."""
    return {c: F.expr(_number_sql(c)) for c in numeric}, {c: F.expr(_category_sql(df, c)) for c in categorical}


def numeric_parameters(
    df: DataFrame, numbers: dict[str, Column], scaling: str
) -> dict[str, tuple[float, float, float]]:
    """(fill, centre, scale) per column that has any value; scale 0 is read as 1.

    Centre and scale are those of the column after its gaps are filled with the median.
    """
    medians = exact_quantiles(df, numbers, [0.5])
    fills = {c: m[0] for c, m in medians.items() if m[0] is not None}
    filled = {c: F.coalesce(numbers[c], F.lit(fill)) for c, fill in fills.items()}
    if not filled:
        return {}
    if scaling == "none":
        return {c: (fill, 0.0, 1.0) for c, fill in fills.items()}
    if scaling == "robust":
        spread = exact_quantiles(df, filled, [0.25, 0.5, 0.75])
        pairs = {c: (q[1], q[2] - q[0]) for c, q in spread.items()}
    else:
        names = list(filled)
        aggregates = []
        for i, c in enumerate(names):
            first, second = (F.avg, F.stddev_pop) if scaling == "standard" else (F.min, F.max)
            aggregates += [first(filled[c]).alias(f"a{i}"), second(filled[c]).alias(f"b{i}")]
        row = df.agg(*aggregates).first()
        pairs = {}
        for i, c in enumerate(names):
            a, b = row[f"a{i}"], row[f"b{i}"]
            pairs[c] = (a, b) if scaling == "standard" else (a, b - a)
    return {c: (fills[c], centre, scale or 1.0) for c, (centre, scale) in pairs.items()}


def category_parameters(
    df: DataFrame, texts: dict[str, Column], max_categories: int = MAX_CATEGORIES
) -> dict[str, tuple[str, list[str]]]:
    """(most frequent value, ascending values) per column that has any value."""
    if not texts:
        return {}
    limit = max_categories * len(texts)
    cells = [F.struct(F.lit(c).alias("column_name"), x.alias("value")) for c, x in texts.items()]
    rows = (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(
            f"The categorical columns hold more than {max_categories} values each; leave out "
            "keys and free text or raise max_categories."
        )
    counts: dict[str, dict[str, int]] = {}
    for r in rows:
        counts.setdefault(r["column_name"], {})[r["value"]] = r["n"]
    return {
        c: (min(counts[c], key=lambda v: (-counts[c][v], v)), sorted(counts[c]))
        for c in texts
        if c in counts
    }


def fit_features(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    scaling: str | None = "none",
    max_categories: int = MAX_CATEGORIES,
) -> FittedFeatures:
    """Fit median/mode imputation, scaling and one-hot encoding on a table.

    Numeric features come first. Values not seen here are encoded as all zeros later.
    """
    scaling = check_scaling(scaling)
    vx.require_columns(df, [*numeric, *categorical])
    numbers, texts = feature_values(df, numeric, categorical)
    numbers = numeric_parameters(df, numbers, scaling)
    categories = category_parameters(df, texts, max_categories)
    return assemble(df, numbers, categories)


def assemble(
    df: DataFrame, numbers: dict[str, tuple[float, float, float]], categories: dict[str, tuple[str, list[str]]]
) -> FittedFeatures:
    """The pipeline of fitted figures: (fill, centre, scale) and (mode, values) per column."""
    if not numbers and not categories:
        raise ValueError("Every feature is empty, so there is nothing to fit.")

    made, inputs, names = [], [], []
    for i, (c, (fill, centre, scale)) in enumerate(numbers.items()):
        x = f"coalesce({_number_sql(c)}, CAST('{fill!r}' AS DOUBLE))"
        if (centre, scale) != (0.0, 1.0):
            x = f"({x} - CAST('{centre!r}' AS DOUBLE)) / CAST('{scale!r}' AS DOUBLE)"
        made.append(f"{x} AS `_n{i}`")
        inputs.append(f"_n{i}")
        names.append(c)
    for i, (c, (mode, values)) in enumerate(categories.items()):
        made.append(f"coalesce({_category_sql(df, c)}, {_text_literal(mode)}) AS `_c{i}`")
        names += [f"{c}_{v}" for v in values]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__")]
    scratch = [m.rsplit("`", 2)[1] for m in made]
    if categories:
        slots = range(len(categories))
        indexers = [
            StringIndexerModel.from_labels(values, f"_c{i}", f"_i{i}", handleInvalid="keep")
            for i, (_, values) in enumerate(categories.values())
        ]
        encoder = OneHotEncoder(
            inputCols=[f"_i{i}" for i in slots], outputCols=[f"_o{i}" for i in slots], dropLast=True
        )
        # The indexer's label metadata gives the sizes, so this fit reads no rows.
        ready = PipelineModel([*stages, *indexers]).transform(df)
        stages += [*indexers, encoder.fit(ready)]
        inputs += [f"_o{i}" for i in slots]
        scratch += [f"_{t}{i}" for t in "io" for i in slots]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    dropped = ", ".join(f"`{s}`" for s in scratch)
    stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({dropped}) FROM __THIS__"))
    return FittedFeatures(PipelineModel(stages), names, list(numbers), list(categories))


@dataclass(frozen=True)
class ClusteringData:
    """``data``: the input columns plus a ``features`` vector."""

    data: DataFrame
    feature_names: list[str]
    numeric_columns: list[str]
    categorical_columns: list[str]
    removed_columns: list[str]
    scaling: str
    preprocessor: PipelineModel


def prepare_clustering_data(
    df: DataFrame,
    numeric_columns: Sequence[str],
    categorical_columns: Sequence[str] | None = None,
    scaling: str = "standard",
) -> ClusteringData:
    """Drop columns without variation, impute, scale and encode the rest."""
    if not isinstance(df, DataFrame):
        raise TypeError("A Spark DataFrame is needed.")
    numeric, categorical = list(numeric_columns), list(categorical_columns or [])
    if not numeric and not categorical:
        raise ValueError("Name a column to cluster by.")
    missing = [c for c in [*numeric, *categorical] if c not in df.columns]
    if missing:
        raise ValueError(f"Columns do not exist: {missing}")
    scaling = check_scaling(scaling)
    values = {c: F.expr(_number_sql(c)) for c in numeric}
    values.update({c: F.expr(_category_sql(df, c)) for c in categorical})
    distinct = distinct_counts(df, values)
    removed = [c for c in values if distinct[c] <= 1]
    numeric = [c for c in numeric if c not in removed]
    categorical = [c for c in categorical if c not in removed]
    if not numeric and not categorical:
        raise ValueError("Every clustering column is constant or empty.")
    fitted = fit_features(df, numeric, categorical, scaling)
    return ClusteringData(
        fitted.model.transform(df), fitted.feature_names, numeric, categorical, removed, scaling,
        fitted.model,
    )

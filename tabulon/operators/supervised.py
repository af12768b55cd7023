"""What the supervised models share: task detection, feature choice, prepared rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import values as vx
from tabulon.operators.distinct import distinct_counts
from tabulon.operators.profile import Profile
from tabulon.session import materialise

ROW_ID = "_row_id"
TARGET = "_target"
LABEL = "_label"
MAX_CLASS_VALUES = 20


@dataclass(frozen=True)
class TaskDetection:
    task_type: str
    target_column: str
    target_dtype: str
    unique_target_values: int
    warning: str | None


def detect_task_type(
    df: DataFrame, target_column: str, max_class_values: int = MAX_CLASS_VALUES
) -> TaskDetection:
    """Classification for text, boolean and few-valued numeric targets, else regression."""
    if not isinstance(df, DataFrame):
        raise TypeError("A Spark DataFrame is needed.")
    if not isinstance(target_column, str):
        raise TypeError("The target is named by a string.")
    if target_column not in df.columns:
        raise ValueError(f"Target column '{target_column}' does not exist.")
    rows, present = df.agg(F.count(F.lit(1)), F.count(vx.present(df, target_column))).first()
    if rows < 3:
        raise ValueError("A supervised task needs three rows or more.")
    if not present:
        raise ValueError("The target has only missing values.")
    unique = distinct_counts(df, {"t": vx.comparable(df, target_column)})["t"]
    if unique < 2:
        raise ValueError("The target needs two distinct values or more.")
    kind = vx.field_of(df, target_column).dataType
    warning = None
    if isinstance(kind, T.NumericType):
        task = "regression"
        if unique <= max_class_values:
            task = "classification"
            warning = (
                f"The numeric target has only {unique} distinct values and is treated as "
                "classification; set task_type='regression' to override this."
            )
    else:
        task = "classification"
        if not isinstance(kind, (T.StringType, T.BooleanType)):
            warning = "The target has an uncommon type and is treated as classification."
    return TaskDetection(task, target_column, kind.simpleString(), unique, warning)


@dataclass(frozen=True)
class FeatureSelection:
    numeric_columns: list[str]
    categorical_columns: list[str]

    @property
    def feature_columns(self) -> list[str]:
        return self.numeric_columns + self.categorical_columns


def select_feature_columns(
    df: DataFrame,
    profile: Profile,
    target_column: str,
    feature_columns: Sequence[str] | None = None,
    exclude_columns: Sequence[str] | None = None,
) -> FeatureSelection:
    """Numeric, then categorical and boolean features; text and datetime are left out."""
    if feature_columns is None:
        feature_columns = (
            profile.numeric_columns + profile.categorical_columns + profile.boolean_columns
        )
    if isinstance(feature_columns, str):
        raise TypeError("Give the features as a list of names.")
    left_out = {target_column, *(exclude_columns or [])}
    wanted = [c for c in dict.fromkeys(feature_columns) if c not in left_out]
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"Feature columns do not exist: {unknown}")
    encoded = {*profile.categorical_columns, *profile.boolean_columns}
    selection = FeatureSelection(
        [c for c in wanted if c in profile.numeric_columns],
        [c for c in wanted if c in encoded],
    )
    if not selection.feature_columns:
        raise ValueError("No supported machine-learning features were selected.")
    return selection


@dataclass(frozen=True)
class Prepared:
    """``data`` holds the features, the row id and, for the task, the numeric label.

    It is written to the checkpoint folder once: the many passes of cross-validation
    read these few columns instead of the source, and row ids cannot change on a retry.
    """

    data: DataFrame
    task_type: str
    detection: TaskDetection
    target_column: str
    selection: FeatureSelection
    class_names: list[str] | None
    rows_used: int
    removed_target_rows: int

    @property
    def number_of_classes(self) -> int | None:
        return len(self.class_names) if self.class_names else None


def prepare_supervised_data(
    df: DataFrame,
    profile: Profile,
    target_column: str,
    feature_columns: Sequence[str] | None = None,
    task_type: str | None = None,
    key: str | None = None,
    exclude_columns: Sequence[str] | None = None,
) -> Prepared:
    """Choose features, drop rows without a target and encode the target.

    ``key`` may name a unique column; folds then stay the same from run to run. Without
    it rows are numbered when the table is written.
    """
    detection = detect_task_type(df, target_column)
    task = detection.task_type if task_type is None else task_type.lower()
    if task not in {"classification", "regression"}:
        raise ValueError("Unknown task_type; it is classification or regression.")
    selection = select_feature_columns(df, profile, target_column, feature_columns, exclude_columns)

    raw = vx.present(df, target_column)
    number = vx.to_number(df, target_column)
    rows, present, usable = df.agg(F.count(F.lit(1)), F.count(raw), F.count(number)).first()
    if present < 3:
        raise ValueError("Fewer than three rows have a target.")
    if task == "regression" and usable < present:
        raise ValueError(
            f"Regression requires a numeric target; {present - usable} values are no numbers."
        )
    row_id = F.monotonically_increasing_id() if key is None else vx.ref(key)
    features = [vx.present(df, c).alias(c) for c in selection.feature_columns]
    target = raw.cast("string") if task == "classification" else number
    rows_kept = df.where(raw.isNotNull())
    narrow = materialise(rows_kept.select(row_id.alias(ROW_ID), *features, target.alias(TARGET)))

    names = None
    if task == "classification":
        names = [r[0] for r in narrow.select(TARGET).distinct().orderBy(TARGET).collect()]  # one per class
        codes = df.sparkSession.createDataFrame(
            [(name, float(i)) for i, name in enumerate(names)], f"{TARGET} string, {LABEL} double"
        )
        # The metadata tells MLlib the number of classes, which it else caps at 100.
        nominal = {"ml_attr": {"type": "nominal", "name": LABEL, "vals": names}}
        narrow = narrow.join(codes, TARGET).withMetadata(LABEL, nominal)
    else:
        narrow = narrow.withColumn(LABEL, F.col(TARGET))
    return Prepared(
        narrow, task, detection, target_column, selection, names, present, rows - present
    )

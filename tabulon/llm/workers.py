"""What Python tasks over long texts need from a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tabulon.session import ship_package

#: Rows per Arrow batch where the session has Spark's default; texts are long rows.
BATCH_ROWS = 1_000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Send the package to the tasks, and keep batches of texts small unless told otherwise."""
    ship_package(spark)
    if spark.conf.get(_SETTING) == "10000":
        spark.conf.set(_SETTING, str(BATCH_ROWS))

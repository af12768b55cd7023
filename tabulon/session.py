"""Session defaults and the shared folder for materialised intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Let Python tasks import this package, as ``--py-files`` would; once per application."""
    context = spark.sparkContext
    package = Path(__file__).parent
    with _SHIPPING:  # folds are fitted by several threads
        if context.applicationId in _SHIPPED or not package.is_dir():
            return
        base = os.path.join(tempfile.mkdtemp(prefix="tabulon-code-"), package.name)
        context.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)


def build_session(app_name: str = "tabulon", master: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A private one is made only when none is set and Spark runs in local mode, where
    driver and tasks share a disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        folder = tempfile.mkdtemp(prefix="tabulon-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Stored:
    """A table written to the shared folder; ``drop`` removes its files when nothing reads them any more."""

    table: DataFrame
    path: str

    def drop(self) -> None:
        remove(self.table.sparkSession, self.path)


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> Stored:
    """Cut lineage through a written table, for rounds whose results should not pile up."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """A written copy for the time of a block; an error of the block is not hidden by the removal."""
    held = store(df)
    try:
        yield held.table
    except BaseException:
        with suppress(Exception):
            held.drop()
        raise
    held.drop()


@contextmanager
def persisted(df: DataFrame) -> Iterator[DataFrame]:
    """A cached table for the time of a block, which keeps an error of the block visible."""
    held = df.persist()
    try:
        yield held
    except BaseException:
        with suppress(Exception):
            held.unpersist()
        raise
    held.unpersist()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, wherever that lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for rows that are read many times over, when few files hold them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

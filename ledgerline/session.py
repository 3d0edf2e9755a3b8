"""Session settings and the shared folder for materialized intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for; pass them to the session builder.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting falls back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="ledgerline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{os.urandom(8).hex()}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_shuffle_files_left(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files when it ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back, so later jobs see the same rows and partitions.

    Shuffle files of the write go as soon as the table is there, so a run cut into such steps holds those of one step at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with no_shuffle_files_left(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote and no later plan reads."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rpartition("/")[0])


def _located(spark: SparkSession, path: str) -> tuple:
    """A path's file system, and the path as that takes it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _located(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    system, target = _located(spark, path)
    system.delete(target, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; only spreadsheet reading needs it."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    base = os.path.join(tempfile.mkdtemp(prefix="ledgerline-package-"), "ledgerline")
    archive = shutil.make_archive(base, "zip", root_dir=package.parent, base_dir=package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)

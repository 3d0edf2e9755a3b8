"""Append-only assertion ledger: dense sequences, appends and as-of reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import Json, instant_text, stable_id
from ledgerline.session import materialize


def dense_sequence(
    rows: DataFrame, order: Sequence[str], base: int = 0, name: str = "sequence", partitions: int | None = None
) -> DataFrame:
    """Number rows base+1, base+2, ... in a total order, without gathering them in one task.

    Rows are range-partitioned by the order and written once, which fixes partition membership.
    Partition sizes (one number per partition) give the offset of each; rows are then numbered
    inside their partition.
    """
    spark = rows.sparkSession
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(width, *order).withColumn("_part", F.spark_partition_id())
    fixed = materialize(ranged, "sequence")
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # offsets holds one row per range partition, at most `width` rows
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.lit(base) + F.col("_offset") + inside)
        .drop("_part", "_offset")
    )


def entry_id() -> Column:
    return stable_id(
        "assertion-entry",
        Json(F.col("sequence").cast("string")),
        F.col("assertion_id"),
        instant_text(F.col("observed_at")),
    )


def last_sequence(ledger: DataFrame) -> int:
    return ledger.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("n")).first()["n"]


def new_entries(batch: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Assertions not yet in the ledger, by assertion and observation time.

    Only ledger partitions of the days in the batch are read; their list is no longer than the calendar.
    """
    once = batch.dropDuplicates(["assertion_id", "observed_at"]).withColumn(
        "observed_date", F.to_date("observed_at")
    )
    if ledger is None:
        return once
    near = ledger.where(touched_days(once))
    keys = ["observed_date", "assertion_id", "observed_at"]
    return once.join(near.select(*keys), keys, "left_anti")


def touched_days(batch: DataFrame) -> Column:
    """Condition on observed_date that holds for the days of a batch only, however far apart they lie."""
    days = [row["observed_date"] for row in batch.select("observed_date").distinct().collect()]
    return F.col("observed_date").isin([day for day in days if day is not None])


def append_entries(batch: DataFrame, ledger: DataFrame | None, base: int = 0) -> DataFrame:
    """Ledger rows for a batch: unseen assertions, numbered after `base` in observation order."""
    return dense_sequence(new_entries(batch, ledger), ["observed_at", "assertion_id"], base)


def write_entries(entries: DataFrame, path: str) -> None:
    """Append to the ledger table, partitioned by observation day."""
    entries.withColumn("observed_date", F.to_date("observed_at")).write.mode(
        "append"
    ).partitionBy("observed_date").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def in_order(ledger: DataFrame) -> DataFrame:
    """Ledger read in sequence order, for a sink that needs it."""
    return ledger.orderBy("sequence")


def as_of(ledger: DataFrame, cutoff: Column) -> DataFrame:
    """Entries observed at or before the cutoff; sequences keep their values."""
    return ledger.where(F.col("observed_at") <= cutoff)

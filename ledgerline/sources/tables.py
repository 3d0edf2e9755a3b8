"""Layout of durable tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_scoped(
    df: DataFrame, path: str, spread: Sequence[str], partitions: int | None = None, mode: str = "append"
) -> None:
    """Append a table partitioned by tenant and project, so that scope filters prune folders.

    Rows are range-partitioned by scope and then by a hash of the `spread` columns: small projects
    share a task and get one file each, a project with most of the rows is written by many tasks.
    """
    width = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("tenant_id"), F.col("project_id"), F.xxhash64(*spread)]
    df.repartitionByRange(width, *order).write.mode(mode).partitionBy("tenant_id", "project_id").parquet(path)

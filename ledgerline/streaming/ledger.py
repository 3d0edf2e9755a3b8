"""Continuous ingest into the append-only ledger, and continuously kept latest observations.

A ledger folder holds `entries`, partitioned by observation day, and `commits`, one row per batch. Entries count once their commit is written,
a single row in a single file, so a batch is either there or not; what a failed attempt left behind is never read. The
commits also tell the highest sequence and which batches are in, so that neither needs a scan of the ledger.

A folder of latest observations holds `changes`, one folder per batch, `snapshot`, one folder per compaction, and `snapshots`, which names the
current one and the last batch in it. Readers take the current snapshot and the batches after it.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.ledger import append_entries, write_entries
from ledgerline.schemas import SCOPE
from ledgerline.session import exists, remove

COMMIT = "commit_id string, source string, batch_id bigint, last_sequence bigint"
SNAPSHOT = "folder string, up_to bigint, made bigint"
# Batches of changes after which a snapshot is made, and files a snapshot has.
COMPACT_EVERY = 16
BUCKETS = 32


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or nothing while it has no data yet."""
    if not exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # a folder without files
        return None


def _logged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one-row files; empty while there is none."""
    log = stored(spark, path)
    return spark.createDataFrame([], schema) if log is None else log


def _log(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch in the ledger: commit_id, source, batch_id, last_sequence."""
    return _logged(spark, f"{path}/commits", COMMIT)


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """Entries of committed batches, or nothing while there are none. Filters on observed_date reach the folders."""
    entries = stored(spark, f"{path}/entries")
    if entries is None:
        return None
    return entries.join(commits(spark, path).select("commit_id").distinct(), "commit_id", "left_semi")


def append_batch(batch: DataFrame, path: str, source: str = "", batch_id: int | None = None) -> None:
    """Append a micro-batch: what the ledger already holds is left out, so replays change nothing.

    A batch of a source that was committed is left out whole. One writer at a time: sequences go on from the last commit.
    """
    spark = batch.sparkSession
    log = commits(spark, path)
    if batch_id is not None and log.where((F.col("source") == source) & (F.col("batch_id") == batch_id)).limit(1).count():
        return
    base = log.agg(F.coalesce(F.max("last_sequence"), F.lit(0)).alias("n")).first()["n"]
    commit_id = os.urandom(8).hex()
    batch = batch.persist()
    try:
        added = append_entries(batch, read_committed(spark, path), base)
        last = Observation()
        write_entries(
            added.withColumn("commit_id", F.lit(commit_id)).observe(last, F.max("sequence").alias("n")), f"{path}/entries"
        )
    finally:
        batch.unpersist()
    _log(spark, f"{path}/commits", COMMIT, (commit_id, source, batch_id, last.get["n"] or base))


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start the continuous ingest of assertions (assertion_id, observed_at, ...) into a ledger folder."""
    writer = stream.writeStream.foreachBatch(lambda batch, i: append_batch(batch, path, checkpoint, i))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    by: Sequence[str] = SCOPE,
    ordinal: str = "input_ordinal",
    **trigger: object,
) -> StreamingQuery:
    """Keep the latest observation per key in streaming state, one row per key.

    The maximum over (as_of, first ordinal) does not depend on arrival order, so late rows need no
    watermark. Changed keys of each batch go to their own folder, which a replay overwrites, until a snapshot takes them in.
    """
    order = F.struct(F.col("as_of"), (-F.col(ordinal)).alias("first"))
    payload = F.struct(*[c for c in stream.columns if c not in (*by, "canonical_key")])
    latest = stream.groupBy(*by, "canonical_key").agg(F.max_by(payload, order).alias("row"))

    def write(changes: DataFrame, batch_id: int) -> None:
        rows = changes.select(*by, "canonical_key", "row.*")
        rows.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        if (batch_id + 1) % COMPACT_EVERY == 0:
            compact_latest(changes.sparkSession, path, by, ordinal)

    writer = latest.writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _snapshots(spark: SparkSession, path: str) -> list:
    """Newest first."""
    return _logged(spark, f"{path}/snapshots", SNAPSHOT).orderBy(F.desc("up_to"), F.desc("made")).limit(2).collect()


def _newest(by: Sequence[str], ordinal: str, rows: DataFrame) -> DataFrame:
    newest = Window.partitionBy(*by, "canonical_key").orderBy(F.desc("as_of"), F.asc(ordinal), F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def _open(spark: SparkSession, path: str, by: Sequence[str], ordinal: str) -> DataFrame | None:
    """Latest observation per key, with its batch: the current snapshot and the batches after it."""
    current = next(iter(_snapshots(spark, path)), None)
    changes = stored(spark, f"{path}/changes")
    if current is None:
        return None if changes is None else _newest(by, ordinal, changes)
    rows = spark.read.parquet(f"{path}/snapshot/{current['folder']}").drop("bucket")
    if changes is not None:
        rows = rows.unionByName(changes.where(F.col("batch") > current["up_to"]))
    return _newest(by, ordinal, rows)


def read_latest(
    spark: SparkSession, path: str, by: Sequence[str] = SCOPE, ordinal: str = "input_ordinal"
) -> DataFrame:
    """Current latest observation per key from what is written so far."""
    rows = _open(spark, path, by, ordinal)
    if rows is None:
        raise LookupError(f"no observations at {path}")
    return rows.drop("batch")


def _bucket(by: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*by, "canonical_key"), F.lit(BUCKETS)).cast("int")


def compact_latest(spark: SparkSession, path: str, by: Sequence[str] = SCOPE, ordinal: str = "input_ordinal") -> None:
    """Make a snapshot of all batches so far, in files by a hash of the key; nothing happens if no batch is open.

    The snapshot counts once its row is written, and a batch that is replayed afterwards is not read again. What the snapshot before the last
    one needed is deleted, so readers that began with the last one can end.
    """
    known = _snapshots(spark, path)
    up_to = known[0]["up_to"] if known else -1
    changes = stored(spark, f"{path}/changes")
    last = None if changes is None else changes.where(F.col("batch") > up_to).agg(F.max("batch").alias("n")).first()["n"]
    if last is None:
        return
    folder = f"{last}-{os.urandom(4).hex()}"
    rows = _open(spark, path, by, ordinal).withColumn("bucket", _bucket(by))
    rows.repartition(BUCKETS, "bucket").write.partitionBy("bucket").parquet(f"{path}/snapshot/{folder}")
    _log(spark, f"{path}/snapshots", SNAPSHOT, (folder, int(last), len(known)))
    for batch in changes.where(F.col("batch") <= up_to).select("batch").distinct().collect():
        remove(spark, f"{path}/changes/batch={batch['batch']}")
    for old in known[1:]:
        remove(spark, f"{path}/snapshot/{old['folder']}")

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from fixtures import SCOPE_VALUES, day
from ledgerline.operators import ledger as ledger_ops
from ledgerline.operators import state
from ledgerline.streaming import ledger as streams

DDL = "tenant_id string, project_id string, site_id string, version string, canonical_key string, ordered_quantity decimal(18,6), freshness string, as_of timestamp, input_ordinal bigint"


def rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    made = [
        (*SCOPE_VALUES.values(), f"k{rng.randrange(6)}", Decimal(rng.randrange(9)), "current", day(rng.randrange(1, 6)), i)
        for i in range(n)
    ]
    rng.shuffle(made)
    return made


def write_files(spark, data, ddl, path, parts=4):
    for i in range(parts):
        spark.createDataFrame(data[i::parts], ddl).coalesce(1).write.mode("append").parquet(path)


def test_latest_stream_equals_batch_whatever_the_arrival_order(spark, tmp_path):
    data = rows(60, 1)
    batch = state.latest_observed(spark.createDataFrame(data, DDL), F.lit(day(9)).cast("timestamp"))
    want = sorted((r.canonical_key, r.as_of, r.input_ordinal) for r in batch.collect())
    for seed in (2, 3):
        random.Random(seed).shuffle(data)
        base = tmp_path / str(seed)
        write_files(spark, data, DDL, str(base / "in"))
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(base / "in"))
        streams.latest_stream(stream, str(base / "out"), str(base / "state")).awaitTermination()
        got = streams.read_latest(spark, str(base / "out")).collect()
        assert sorted((r.canonical_key, r.as_of, r.input_ordinal) for r in got) == want


def test_ledger_stream_is_idempotent(spark, tmp_path):
    ddl = "assertion_id string, observed_at timestamp, value_text string"
    data = [(f"a{i % 30}", day(1 + i % 3), "v") for i in range(90)]
    write_files(spark, data, ddl, str(tmp_path / "in"), parts=3)

    def ingest(name: str) -> list:
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streams.ingest_stream(stream, str(tmp_path / "ledger"), str(tmp_path / name)).awaitTermination()
        return streams.read_committed(spark, str(tmp_path / "ledger")).drop("commit_id").collect()

    first, second = ingest("one"), ingest("two")
    assert sorted(r.sequence for r in first) == list(range(1, len(set(d[:2] for d in data)) + 1))
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))


def test_batches_continue_the_sequence(spark, tmp_path):
    ddl = "assertion_id string, observed_at timestamp, value_text string"
    path = str(tmp_path / "ledger")
    for start in (0, 5, 5):
        streams.append_batch(spark.createDataFrame([(f"a{i}", day(1), "v") for i in range(start, start + 10)], ddl), path)
    rows_ = streams.read_committed(spark, path).collect()
    assert sorted(r.sequence for r in rows_) == list(range(1, 16)) and len({r.assertion_id for r in rows_}) == 15


ENTRY = "assertion_id string, observed_at timestamp, value_text string"


def test_batches_read_their_own_days_and_replays_add_nothing(spark, tmp_path):
    """A late row of an early day, a replayed batch, and an attempt that failed before its commit."""
    path = str(tmp_path / "ledger")
    batches = [[(f"a{i}", day(i), "v") for i in (1, 2, 3)], [("b", day(9), "v"), ("late", day(1), "v"), ("a1", day(1), "v")], [("c", day(5), "v")]]
    for i, batch in enumerate(batches):
        streams.append_batch(spark.createDataFrame(batch, ENTRY), path, "s", i)
    whole = sorted(map(tuple, streams.read_committed(spark, path).collect()))
    assert sorted(r[0] for r in streams.read_committed(spark, path).select("sequence").collect()) == [1, 2, 3, 4, 5, 6]
    streams.append_batch(spark.createDataFrame(batches[1], ENTRY), path, "s", 1)
    streams.append_batch(spark.createDataFrame(batches[1], ENTRY), path, "other", 1)
    left = spark.createDataFrame([("lost", day(2), "v", 99, "nothing")], ENTRY + ", sequence bigint, commit_id string")
    ledger_ops.write_entries(left, f"{path}/entries")
    assert sorted(map(tuple, streams.read_committed(spark, path).collect())) == whole
    again = spark.createDataFrame([("lost", day(2), "v")], ENTRY)
    streams.append_batch(again, path, "s", 3)
    assert streams.read_committed(spark, path).where("assertion_id = 'lost'").first()["sequence"] == 7
    near = ledger_ops.new_entries(spark.createDataFrame(batches[1], ENTRY), streams.read_committed(spark, path))
    plan = near._jdf.queryExecution().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "observed_date" in line]
    assert filters and all("2026-01-09" in f or str(day(9).date()) in f for f in filters) and str(day(5).date()) not in "".join(filters)


def test_an_empty_batch_is_committed(spark, tmp_path):
    path = str(tmp_path / "ledger")
    streams.append_batch(spark.createDataFrame([("a", day(1), "v")], ENTRY), path, "s", 0)
    streams.append_batch(spark.createDataFrame([], ENTRY), path, "s", 1)
    assert [r.last_sequence for r in streams.commits(spark, path).orderBy("batch_id").collect()] == [1, 1]


def test_snapshots_take_batches_in(spark, tmp_path, monkeypatch):
    """Readers see the same with and without snapshots; closed batches are not read and go, a replay of one changes nothing."""
    monkeypatch.setattr(streams, "COMPACT_EVERY", 3)
    data = rows(80, 5)
    want = sorted(
        (r.canonical_key, r.as_of, r.input_ordinal)
        for r in state.latest_observed(spark.createDataFrame(data, DDL), F.lit(day(9)).cast("timestamp")).collect()
    )
    write_files(spark, data, DDL, str(tmp_path / "in"), parts=11)
    out = tmp_path / "out"
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.latest_stream(stream, str(out), str(tmp_path / "state")).awaitTermination()

    def seen():
        return sorted((r.canonical_key, r.as_of, r.input_ordinal) for r in streams.read_latest(spark, str(out)).collect())

    assert seen() == want
    batches = sorted(int(p.name.split("=")[1]) for p in (out / "changes").iterdir() if p.name.startswith("batch="))
    assert batches == [6, 7, 8, 9, 10]  # up to 5 went with the snapshot of 8, which replaced that of 5
    assert len(list((out / "snapshot").iterdir())) == 2
    stale = [(*SCOPE_VALUES.values(), "k0", Decimal(1), "current", day(20), 1)]
    spark.createDataFrame(stale, DDL).write.mode("overwrite").parquet(str(out / "changes/batch=7"))
    assert seen() == want
    streams.compact_latest(spark, str(out))
    streams.compact_latest(spark, str(out))
    assert seen() == want

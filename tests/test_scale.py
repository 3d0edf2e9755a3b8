"""What keeps disk and time of large runs low: shuffles that a query's last step still needs, tables written once."""

from __future__ import annotations

import os
import re
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from ledgerline import session
from ledgerline.operators import bom, governed, lineage, members
from ledgerline.registry import ledger

# Shuffles in the plan that is left when a query returns; all earlier steps are written by then, and their shuffle files gone.
SHUFFLES = {
    "claim_ids": 6,
    "event_assertion_ids": 1,
    "review_evidence": 4,
    "review_context": 6,
    "canonicalized_assertion_ids": 4,
    "resolution_decision_ids": 4,
    "run_provenance": 1,
    "stage_trace": 3,
    "decision_input_ids": 3,
    "evidence_chain": 3,
    "sku_worklist": 6,
    "export_chain_json": 3,
    "scenario_cost": 8,
}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_shuffles_of_the_last_step(spark, sf_dir, name):
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange hash", plan)) <= SHUFFLES[name], plan


def test_written_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return set(re.findall(r"shuffle_\d+_\d+_\d+", blocks.getAllFiles().mkString(" ")))

    before, setting = shuffled(), spark.conf.get(session.CLEANUP, None)
    back = session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "left")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(session.CLEANUP, None) == setting
    assert back.count() == 7
    folder = back.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    session.discard(back)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("fanout", [1000, 10])
def test_lists_of_crowded_buckets_are_those_of_others(spark, monkeypatch, fanout):
    monkeypatch.setattr(members, "FANOUT", fanout)
    rows = [(None if k == 3 else f"k{k}", i % 5, f"e{i // 2}") for k, n in enumerate([1, 40, 90, 7, 100]) for i in range(n)]
    frame = spark.createDataFrame(rows, "key string, n int, evidence_id string").repartition(6)
    whole = members.id_lists(frame, ["key"], ["n"])
    assert str(whole._jdf.queryExecution().executedPlan().toString()).count("Exchange hash") == 1
    monkeypatch.setattr(members, "WHOLE", 20)
    spread = members.id_lists(frame, ["key"], ["n"])
    assert sorted(map(str, spread.collect())) == sorted(map(str, whole.collect()))
    assert {r.id_count for r in spread.collect()} == {1, 40, 90, 7, 100}


def test_each_round_of_a_walk_replaces_the_one_before(spark):
    folder = session.shared_folder(spark)
    before = set(os.listdir(folder))
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)], "node string, target string")
    assert lineage.origins(links).count() == 20
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("lineage-")]) == 1


def test_observations_of_a_run_are_made_once(spark, sf_dir, monkeypatch):
    made, make = [], ledger.observations
    monkeypatch.setattr(ledger, "observations", lambda *a: made.append(a) or make(*a))
    rows = {r.stage: r.row_count for r in contract.queries()["observed_stages"](spark, sf_dir).collect()}
    assert len(made) == 1 and rows["ASSERT"] > 0


def test_evidence_of_a_line_is_hashed_once(spark):
    rows = [("a.xlsx", "h", "lineitem", "1-2", "A-1", "a gpu", Decimal(2), Decimal(3)), ("a.xlsx", "h", "lineitem", None, "B", None, Decimal(1), None)]
    names = "artifact_id string, content_hash string, collection string, record_key string, sku string, description string, quantity decimal(18,6), unit_price decimal(18,6)"
    lines = spark.createDataFrame(rows, names)
    once = bom.with_assertion_ids(bom.bom_assertions(lines, located=True))
    assert once.columns == bom.with_assertion_ids(bom.bom_assertions(lines)).columns
    assert sorted(map(str, once.collect())) == sorted(map(str, bom.with_assertion_ids(bom.bom_assertions(lines)).collect()))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "evidence:" in plan[plan.index("Generate ") :] and "evidence:" not in plan[: plan.index("Generate ")]


def test_members_of_a_bundle_are_made_once(spark, monkeypatch):
    written, write = [], session.materialize
    monkeypatch.setattr(governed, "materialize", lambda rows, label: written.append(write(rows, label)) or written[-1])
    rows = [("t", "p", "s", "1", "evidence", f"e{i % 4}") for i in range(9)] + [("t", "p", "s", "1", "states", "x")]
    items = spark.createDataFrame(rows, "tenant_id string, project_id string, site_id string, version string, list string, item_id string")
    at = F.lit("2024-01-01").cast("timestamp")
    (row,) = governed.identified_bundles(items.withColumn("as_of", at), "prediction-input", at).collect()
    assert (row.evidence_count, row.states_count) == (4, 1) and [t.count() for t in written] == [5]

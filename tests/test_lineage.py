"""Edges and walks of lineage."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerline.errors import ContractError
from ledgerline.operators import lineage
from ledgerline.sources import workbooks

EDGE = "node string, relation string, target string"


def plain(links):
    """All (node, origin) by a walk from each node."""
    below = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            below.setdefault(a, set()).add(b)
    found = set()
    for start in below:
        todo, seen = [start], set()
        while todo:
            for b in below.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        found |= {(start, b) for b in seen if b not in below}
    return found


def walked(spark, links):
    rows = [(a, "used", b) for a, b in links]
    return sorted((r.node, r.origin) for r in lineage.origins(spark.createDataFrame(rows, EDGE)).collect())


def test_origins_of_a_graph_with_paths_of_many_lengths(spark):
    rng = random.Random(4)
    links = [(f"n{a:02d}", f"n{b:02d}") for a in range(60) for b in rng.sample(range(a), min(a, rng.choice([0, 1, 2])))]
    links += links[:9] + [("n07", "n07"), (None, "n01"), ("n01", None)]
    assert walked(spark, links) == sorted(plain(links))


def test_origins_of_a_long_path(spark):
    links = [(str(i), str(i + 1)) for i in range(37)]
    assert walked(spark, links) == sorted((str(i), "37") for i in range(37))


def test_origins_of_nothing_and_of_a_cycle(spark):
    assert walked(spark, []) == []
    with pytest.raises((ContractError, PySparkException)):
        walked(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])


def test_a_hub_that_most_nodes_use(spark):
    links = [(f"c{i}", "hub") for i in range(500)] + [("hub", "x"), ("hub", "y")]
    assert walked(spark, links) == sorted([(f"c{i}", o) for i in range(500) for o in "xy"] + [("hub", "x"), ("hub", "y")])


def test_claims_lead_to_the_artifacts_of_their_own_lines(spark):
    scope = ("t", "p", "s", "1")
    rows = [(*scope, "one.xlsx", "h1", "A-1", "a gpu"), (*scope, "two.xlsx", "h2", "B-1", "a cable"), (*scope, "two.xlsx", "h2", "zz", "unknown")]
    names = "tenant_id string, project_id string, site_id string, version string, artifact_id string, content_hash string, sku string, description string"
    lines = spark.createDataFrame(rows, names)
    events = workbooks.events_of(lines.select("artifact_id", "content_hash").distinct())
    links = lineage.bom_edges(lines, spark.createDataFrame([("A1",), ("B1",)], "candidate string"), events)
    found = {}
    for r in lineage.origins(links).where(F.col("node").startswith('["claim"')).collect():
        found.setdefault(r.node.split('"')[3], set()).add(r.origin)
    schema = "schema:bom-xlsx-v1"
    assert found == {
        "distinct_skus": {"artifact:h1", "artifact:h2", schema}, "bom_cost": {"artifact:h1", "artifact:h2", schema}, "gpu_quantity": {"artifact:h1", schema}
    }


def test_lines_without_an_event_keep_a_null(spark):
    lines = spark.createDataFrame([("one.xlsx", "h1", "A"), ("two.xlsx", None, "B")], "artifact_id string, content_hash string, sku string")
    events = workbooks.events_of(spark.createDataFrame([("one.xlsx", "h1")], "artifact_id string, content_hash string"))
    found = {r.sku: r.transformation_event_id for r in workbooks.with_events(lines, events).collect()}
    assert found["A"].startswith("transformation-event:") and found["B"] is None

"""Evidence references and evidence chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import Json, json_ids, stable_id

def evidence_id(columns: Sequence[str]) -> Column:
    """Identifier of a row's evidence; `columns` tells which location kinds the table can hold."""
    located = [F.col("artifact_id"), F.col("content_hash")]
    tabular = record = None
    if "cells" in columns:
        row, cells = F.col("row").cast("string"), F.col("cells")
        tabular = stable_id("evidence", *located, F.col("sheet"), Json(row), Json(json_ids(cells)))
    if "record_key" in columns:
        record = stable_id("evidence", *located, F.lit("record"), F.col("collection"), F.col("record_key"))
    if tabular is None:
        return record
    if record is None:
        return tabular
    return F.when(F.col("location_kind") == "tabular", tabular).otherwise(record)


def record_evidence_id(artifact: Column, content_hash: Column, collection: Column, key: Column) -> Column:
    return stable_id("evidence", artifact, content_hash, F.lit("record"), collection, key)


# Node kinds and labels of the four-step chain, in order.
CHAIN_STEPS = (
    ("source_assertion", "source assertions"),
    ("resolution", "entity resolution"),
    ("operational_state", "operational state"),
    ("reconciliation", "reconciliation"),
)


def chain_nodes(statuses: Sequence[Column], ids_json: Column) -> Column:
    """Array of nodes; every node of one chain refers to the same evidence list."""
    nodes = []
    for (kind, label), status in zip(CHAIN_STEPS, statuses):
        node_id = stable_id("evidence-node", F.lit(kind), F.lit(label), status, Json(ids_json))
        nodes.append(
            F.struct(
                node_id.alias("node_id"),
                F.lit(kind).alias("kind"),
                F.lit(label).alias("label"),
                status.alias("status"),
            )
        )
    return F.array(*nodes)


def with_chain(rows: DataFrame, claim: Column, statuses: Sequence[Column]) -> DataFrame:
    """Attach `nodes` and `chain_id`; `ids_json` must be present."""
    rows = rows.withColumn("nodes", chain_nodes(statuses, F.col("ids_json")))
    return rows.withColumn("chain_id", stable_id("evidence-chain", claim, Json(json_ids(F.col("nodes.node_id")))))


def source_chain(rows: DataFrame, claim: Column) -> DataFrame:
    """One-node chain over raw source assertions, with the claim id derived from it."""
    chained = with_chain(rows, claim, [F.lit("observed")])
    return chained.withColumn("claim_id", stable_id("claim", claim, F.col("chain_id")))


def pipeline_statuses(
    decision_count: Column, unresolved_count: Column, operational_count: Column, reconciliation: Column
) -> list[Column]:
    """Node statuses of the four-step chain."""
    resolved = (decision_count > 0) & (unresolved_count == 0)
    return [
        F.lit("observed"),
        F.when(resolved, "resolved").otherwise("partially_resolved"),
        F.when(operational_count > 0, "observed").otherwise("unresolved"),
        reconciliation,
    ]


def lookup_evidence(lines: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source lines of the requested evidence ids, and the ids nothing is known about."""
    located = lines.withColumn("evidence_id", evidence_id(lines.columns))
    wanted = requested.select("evidence_id").distinct()
    found = located.join(wanted, "evidence_id")
    missing = wanted.join(located.select("evidence_id"), "evidence_id", "left_anti")
    return found, missing

"""Execution and decision provenance as dimension rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import Json, json_ids, json_text, stable_id

# The manifest of an unconfigured local run.
LOCAL_RUN = {
    "run_id": "local",
    "workflow_name": "bom-pipeline",
    "workflow_version": "dev",
    "code_revision": "working-tree",
    "image_digest": "local",
    "config_digest": "local",
    "dependency_lock_digest": None,
}

# Components of the decision steps, of states and facts, and of workbook structuring.
RESOLVER = ("normalized-exact-resolver", "deterministic", "1")
RECONCILER = ("deterministic-reconciliation", "deterministic", "1")
STATE_BUILDER = ("operational-state-builder", "deterministic", "1")
DERIVER = ("outstanding-deriver", "deterministic", "1")
STRUCTURER = ("xlsx-bom-structurer", "deterministic", "1")
WORKBOOK_SCHEMA = "bom-xlsx-v1"

RUN_PARTS = tuple(LOCAL_RUN)
COMPONENT_PARTS = (
    "component_name",
    "component_kind",
    "implementation_version",
    "policy_version",
    "model_provider",
    "model_id",
    "model_revision",
    "prompt_version",
    "schema_version",
)


def local_run(snapshots: Column | None = None) -> dict[str, Column]:
    """Literal columns of the local run."""
    row = {name: F.lit(value).cast("string") for name, value in LOCAL_RUN.items()}
    row["input_snapshot_ids"] = F.array().cast("array<string>") if snapshots is None else snapshots
    return row


def run_id(row: dict[str, Column] | None = None) -> Column:
    """Run identifier. Start time, environment and parent run do not enter."""
    get = (lambda name: F.col(name)) if row is None else row.__getitem__
    return stable_id("run", *[get(name) for name in RUN_PARTS], Json(json_ids(get("input_snapshot_ids"))))


def component_provenance(run: Column, component: tuple[str, str, str], schema_version: str | None = None) -> Column:
    """Provenance id of a decision by a fixed component."""
    values = [*component, None, None, None, None, None, schema_version]
    return stable_id("decision-provenance", run, *[F.lit(v).cast("string") for v in values])


def with_snapshots(existing: Column, added: Column) -> Column:
    """Snapshot ids, each once, in first-seen order."""
    return F.array_distinct(F.concat(existing, added))


def decision_provenance(runs: DataFrame, components: DataFrame) -> DataFrame:
    """Provenance rows: each run with the components it executed (run_id, component columns)."""
    identified = runs.withColumn("context_id", run_id())
    named = identified.select("run_id", "context_id").join(components, "run_id")
    return named.withColumn(
        "provenance_id",
        stable_id("decision-provenance", F.col("context_id"), *[F.col(name) for name in COMPONENT_PARTS]),
    )


def transformation_event_id(
    event_type: str, provenance: Column, inputs: list[tuple[str, Column]], outputs: list[Column]
) -> Column:
    """Identifier of an event with the given (relation, target) inputs and output ids."""
    edges = [
        F.concat(F.lit("["), json_text(F.lit(relation)), F.lit(","), json_text(target), F.lit("]"))
        for relation, target in inputs
    ]
    listed = F.concat(F.lit("["), F.concat_ws(",", *edges), F.lit("]"))
    return stable_id(
        "transformation-event",
        F.lit(event_type),
        provenance,
        Json(listed),
        Json(json_ids(F.array(*outputs))),
        Json(F.lit("[]")),
    )

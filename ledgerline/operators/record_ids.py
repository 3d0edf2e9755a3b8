"""Identifiers of the remaining record tables, as ordered lists of typed parts.

List parts are JSON fragments named `<list>_json`, as `members.id_lists` makes them; value parts are
canonical text. Records with identifiers of their own module (claims, anomalies, purchasing, ...)
are not repeated here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import Json, decimal_text, instant_text, scope_text, stable_id

Part = Callable[[], "Column | Json"]


def text(name: str) -> Part:
    return lambda: F.col(name)


def instant(name: str) -> Part:
    return lambda: instant_text(F.col(name))


def number(name: str) -> Part:
    return lambda: decimal_text(F.col(name))


def listed(name: str) -> Part:
    return lambda: Json(F.coalesce(F.col(f"{name}_json"), F.lit("[]")))


def scope() -> Column:
    return scope_text()


# The parts of each identifier, in order.
RECORDS: dict[str, tuple[Part, ...]] = {
    "entity-mention": (text("text"), text("entity_type"), listed("assertions"), scope, instant("observed_at")),
    "canonicalized-assertion": (text("assertion_id"), text("decision_id"), scope, instant("effective_at")),
    "reconciliation-decision": (
        text("subject_key"),
        text("status"),
        listed("governing"),
        listed("losing"),
        text("policy_id"),
        text("rationale"),
        text("provenance_id"),
    ),
    "derived-fact": (
        text("subject_key"),
        text("predicate"),
        text("value_text"),
        scope,
        instant("as_of"),
        listed("evidence"),
        listed("states"),
        text("provenance_id"),
        text("unit"),
    ),
    "prediction-input": (scope, instant("as_of"), listed("evidence"), listed("states")),
    "prediction": (
        text("subject_key"),
        text("outcome"),
        text("value_text"),
        number("confidence"),
        text("uncertainty_basis"),
        scope,
        instant("as_of"),
        instant("horizon_start"),
        instant("horizon_end"),
        listed("evidence"),
        text("input_id"),
        text("provenance_id"),
        text("unit"),
    ),
    "decision-input": (scope, instant("as_of"), listed("facts"), listed("anomalies"), listed("predictions")),
    "decision": (
        text("subject_key"),
        text("outcome"),
        text("rationale"),
        text("policy_id"),
        text("authority_id"),
        text("input_id"),
        listed("evidence"),
        instant("decided_at"),
        text("provenance_id"),
    ),
    "action-approval": (text("decision_id"), text("authority_id"), instant("approved_at"), listed("evidence")),
    "action-result": (
        text("decision_id"),
        text("approval_id"),
        text("action_kind"),
        text("idempotency_key"),
        text("status"),
        instant("attempted_at"),
        instant("completed_at"),
        text("external_reference"),
        text("failure_reason"),
        listed("evidence"),
        text("provenance_id"),
    ),
    "structured-document": (text("artifact_id"), listed("elements"), text("provenance_id")),
    "mapped-document": (text("document_id"), text("mapping_schema"), listed("fields"), text("provenance_id")),
    "normalized-observation": (
        text("observation_key"),
        text("subject_hint"),
        text("predicate"),
        text("value_text"),
        text("unit"),
        text("field_key"),
        scope,
        instant("effective_at"),
        text("status"),
        text("provenance_id"),
    ),
}


def record_id(namespace: str) -> Column:
    """Identifier of a record from the columns of its row."""
    return stable_id(namespace, *[part() for part in RECORDS[namespace]])


def with_record_id(rows: DataFrame, namespace: str, name: str | None = None) -> DataFrame:
    return rows.withColumn(name or f"{namespace.replace('-', '_')}_id", record_id(namespace))

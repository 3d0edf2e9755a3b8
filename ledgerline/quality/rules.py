"""The rules of every table. Conditions name columns; facts about members are added by `checks`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline import errors
from ledgerline.functions import is_blank
from ledgerline.quality.checks import Rule
from ledgerline.schemas import SCOPE

Condition = Callable[[], Column]

STATE_FRESHNESS = ("current", "partial", "stale", "unknown")


def _blank(*names: str) -> Condition:
    def broken() -> Column:
        condition = F.lit(False)
        for name in names:
            condition = condition | is_blank(F.col(name))
        return condition

    return broken


def _empty(*names: str) -> Condition:
    """Null or zero-length; white space passes."""

    def broken() -> Column:
        condition = F.lit(False)
        for name in names:
            condition = condition | F.col(name).isNull() | (F.col(name) == "")
        return condition

    return broken


def _blank_if_present(*names: str) -> Condition:
    def broken() -> Column:
        condition = F.lit(False)
        for name in names:
            condition = condition | (F.col(name).isNotNull() & is_blank(F.col(name)))
        return condition

    return broken


def _not_quantity(*names: str) -> Condition:
    """Missing (hence not a finite decimal) or negative."""

    def broken() -> Column:
        condition = F.lit(False)
        for name in names:
            condition = condition | F.col(name).isNull() | (F.col(name) < 0)
        return condition

    return broken


def _missing(*names: str) -> Condition:
    def broken() -> Column:
        condition = F.lit(False)
        for name in names:
            condition = condition | F.col(name).isNull()
        return condition

    return broken


def _sql(condition: str) -> Condition:
    return lambda: F.expr(condition)


def _instant(*names: str) -> Rule:
    return Rule("instant_missing", _missing(*names), errors.TEMPORAL, "an instant with a zone is required")


def _members(prefix: str, code: str = errors.CONTRACT) -> tuple[Rule, Rule]:
    return (
        Rule(f"{prefix}_missing", _sql(f"{prefix}_count = 0"), code),
        Rule(f"{prefix}_repeated", _sql(f"{prefix}_distinct < {prefix}_count"), code),
    )


_SCOPE_DIFFERS = " or ".join(f"input_{c} <> {c}" for c in SCOPE)

EVIDENCE = [
    Rule("source_missing", _blank("artifact_id", "content_hash")),
    Rule("sheet_missing", lambda: (F.col("location_kind") == "tabular") & _empty("sheet")()),
    Rule("row_not_positive", _sql("location_kind = 'tabular' and (row is null or row < 1)")),
    Rule("cells_missing", _sql("location_kind = 'tabular' and (cells = '' or cells is null or array_contains(split(cells, ','), ''))")),
    Rule("cells_repeated", _sql("location_kind = 'tabular' and size(array_distinct(split(cells, ','))) < size(split(cells, ','))")),
    Rule("record_missing", lambda: (F.col("location_kind") == "record") & _empty("collection", "record_key")()),
]

# The same for evidence that lists its cells in an array, as spreadsheets are read.
CELLS_LISTED = {
    "cells_missing": "location_kind = 'tabular' and (cells is null or size(cells) = 0 or exists(cells, c -> c is null or trim(c) = ''))",
    "cells_repeated": "location_kind = 'tabular' and size(array_distinct(cells)) < size(cells)",
}
EVIDENCE_LISTED = [
    Rule(rule.name, _sql(CELLS_LISTED[rule.name])) if rule.name in CELLS_LISTED else rule for rule in EVIDENCE
]

RESULTS = [Rule("unresolved_with_value", _sql("status = 'unresolved' and value is not null"))]

BOQ_LINES = [
    Rule("line_id_blank", _blank("line_id")),
    Rule("item_key_blank", _blank("item_key")),
    Rule("description_blank", _blank("description")),
    Rule("unit_blank", _blank("unit")),
    Rule("quantity_invalid", _not_quantity("quantity")),
]

BOQ = [
    Rule("number_blank", _blank("boq_number", "revision")),
    Rule("revision_differs", _sql("version is distinct from revision")),
    _instant("as_of"),
    *_members("lines"),
]

PO_LINES = [
    Rule("text_blank", _blank("line_id", "item_key", "unit")),
    Rule("quantity_invalid", _not_quantity("quantity")),
    Rule("price_invalid", _not_quantity("unit_price")),
    Rule("currency_invalid", lambda: F.col("currency").isNull() | ~F.col("currency").rlike(r"\A[A-Z]{3}\z")),
    Rule(
        "boq_reference_partial",
        _sql("size(filter(array(boq_id, boq_line_id, boq_version), x -> x is not null)) not in (0, 3)"),
    ),
    Rule("boq_reference_blank", _blank_if_present("boq_id", "boq_line_id")),
]

PURCHASE_ORDERS = [
    Rule("number_blank", _blank("order_number", "supplier_key")),
    _instant("issued_at"),
    *_members("lines"),
    Rule("boq_scope_differs", _sql("foreign_lines > 0")),
]

EXPECTED = [
    Rule("key_missing", _empty("canonical_key")),
    Rule("quantity_invalid", _not_quantity("required_quantity")),
    _instant("as_of"),
    Rule("evidence_missing", _sql("evidence_count = 0")),
]

OBSERVED = [
    Rule("key_missing", _empty("canonical_key")),
    *[
        Rule(f"{name}_invalid", _not_quantity(name))
        for name in (
            "ordered_quantity",
            "received_quantity",
            "substituted_quantity",
            "delayed_quantity",
            "unknown_quantity",
        )
    ],
    _instant("as_of"),
    Rule("evidence_missing", _sql("evidence_count = 0")),
]

PAIRS = [
    Rule("keys_differ", _sql("observed_key is not null and observed_key <> canonical_key")),
    Rule("scopes_differ", _sql("observed_key is not null and (" + _SCOPE_DIFFERS.replace("input_", "observed_") + ")")),
]

ASSERTIONS = [Rule("subject_missing", _empty("subject_key", "source_system"))]

LEDGER = [Rule("sequence_not_positive", _sql("sequence is null or sequence < 1")), _instant("observed_at")]

MENTIONS = [
    Rule("text_blank", _blank("text", "entity_type")),
    Rule("assertions_missing", _sql("assertion_count = 0")),
    _instant("observed_at"),
]

RESOLUTION_DECISIONS = [
    Rule("text_blank", _blank("mention", "rationale")),
    Rule("resolved_without_key", lambda: (F.col("status") == "resolved") & is_blank(F.col("canonical_key"))),
    Rule("unresolved_with_key", _sql("status = 'unresolved' and canonical_key is not null")),
]

CANONICALIZED = [
    Rule("not_resolved", _sql("status <> 'resolved'")),
    Rule("key_missing", _sql("canonical_key is null")),
    Rule("subject_foreign", _sql("subject_strays > 0")),
    _instant("effective_at"),
]

RECONCILIATION_DECISIONS = [
    Rule("text_blank", _blank("subject_key", "policy_id", "rationale")),
    Rule("governing_missing", _sql("status <> 'unresolved' and governing_count = 0")),
    Rule("governing_unexpected", _sql("status = 'unresolved' and governing_count > 0")),
    Rule("assertions_repeated", _sql("assertions_distinct < assertions_count")),
    Rule("subjects_differ", _sql("foreign_subjects > 0")),
    Rule("scopes_differ", _sql("scopes_distinct > 1")),
]

PRECEDENCE = list(_members("sources"))

ATTRIBUTES = [
    Rule("name_blank", _blank("name")),
    Rule("unit_blank", _blank_if_present("unit")),
    Rule("missing_not_unresolved", _sql("value is null and status <> 'unresolved'")),
    Rule("unresolved_with_value", _sql("value is not null and status = 'unresolved'")),
    *_members("evidence"),
]

STATES = [
    Rule("subject_blank", _blank("subject_key")),
    _instant("as_of"),
    *_members("attributes"),
    *_members("evidence"),
    Rule("evidence_incomplete", _sql("evidence_strays > 0")),
    Rule("reconciliation_blank", _blank_if_present("reconciliation_id")),
]

DERIVED_FACTS = [
    Rule("subject_blank", _blank("subject_key", "predicate")),
    Rule("value_missing", _missing("value")),
    _instant("as_of"),
    *_members("evidence"),
    *_members("states"),
    Rule("state_id_blank", _sql("blank_states > 0")),
    Rule("status_not_inferred", _sql("status <> 'inferred'")),
    Rule("unit_blank", _blank_if_present("unit")),
]

ANOMALIES = [
    Rule("subject_blank", _blank("subject_key", "policy_id")),
    *_members("evidence"),
    _instant("detected_at"),
    Rule("scope_missing", _missing(*SCOPE), errors.SCOPE),
]

SOURCE_REFERENCES = [
    Rule("source_blank", _blank("source_system", "source_uri")),
    _instant("observed_at"),
    Rule("version_blank", _blank_if_present("source_version")),
]

ARTIFACTS = [
    Rule("content_blank", _blank("content_hash", "media_type")),
    Rule("length_negative", _not_quantity("byte_length")),
    _instant("captured_at"),
    Rule("captured_before_observed", _sql("captured_at < observed_at"), errors.TEMPORAL),
]

ELEMENTS = [
    Rule("text_blank", _blank("element_id", "kind")),
    Rule("ordinal_negative", _not_quantity("ordinal")),
    Rule("evidence_foreign", _sql("evidence_artifact_id <> artifact_id or evidence_hash <> content_hash")),
]

STRUCTURED_DOCUMENTS = [
    Rule("element_ids_repeated", _sql("elements_distinct < elements_count")),
    Rule("ordinals_repeated", _sql("ordinals_distinct < ordinals_count")),
]

MAPPED_FIELDS = [
    Rule("text_blank", _blank("field_key", "field_name")),
    Rule(
        "missing_not_explained",
        _sql("raw_value is null and (status <> 'unresolved' or coalesce(diagnostic, '') = '')"),
    ),
    Rule("unresolved_with_value", _sql("raw_value is not null and status = 'unresolved'")),
]

MAPPED_DOCUMENTS = [
    Rule("schema_blank", _blank("mapping_schema")),
    Rule("field_keys_repeated", _sql("fields_distinct < fields_count")),
    Rule("evidence_foreign", _sql("evidence_strays > 0")),
]

OBSERVATIONS = [
    Rule("text_blank", _blank("observation_key", "subject_hint", "predicate")),
    Rule("unit_blank", _blank_if_present("unit")),
    _instant("effective_at"),
    Rule("missing_not_explained", _sql("value is null and (status <> 'unresolved' or coalesce(diagnostic, '') = '')")),
    Rule("unresolved_with_value", _sql("value is not null and status = 'unresolved'")),
    Rule("value_from_nothing", _sql("raw_value is null and value is not null")),
]

PREDICTION_INPUTS = [
    _instant("as_of"),
    Rule("input_empty", _sql("evidence_count = 0 and states_count = 0")),
    Rule("evidence_repeated", _sql("evidence_distinct < evidence_count")),
    Rule("states_repeated", _sql("states_distinct < states_count")),
    Rule("scopes_differ", _sql("foreign_states > 0"), errors.SCOPE_MISMATCH),
    Rule("future_state", _sql("future_states > 0"), errors.TEMPORAL),
]

PREDICTIONS = [
    Rule("subject_blank", _blank("subject_key", "outcome")),
    Rule("value_missing", _missing("predicted_value")),
    Rule("confidence_invalid", _sql("confidence is null or confidence < 0 or confidence > 1")),
    Rule("basis_blank", _blank("uncertainty_basis")),
    _instant("as_of", "horizon_start", "horizon_end"),
    Rule("horizon_invalid", _sql("not (as_of <= horizon_start and horizon_start <= horizon_end)"), errors.TEMPORAL),
    *_members("evidence"),
    Rule("scopes_differ", _sql(_SCOPE_DIFFERS), errors.SCOPE_MISMATCH),
    Rule("before_input", _sql("input_as_of > as_of"), errors.TEMPORAL),
    Rule("evidence_foreign", _sql("evidence_strays > 0")),
    Rule("unit_blank", _blank_if_present("unit")),
]

DECISION_INPUTS = [
    _instant("as_of"),
    Rule("input_empty", _sql("members_count = 0")),
    Rule("members_repeated", _sql("members_distinct < members_count")),
    Rule("scopes_differ", _sql("foreign_members > 0"), errors.SCOPE_MISMATCH),
    Rule("future_member", _sql("future_members > 0"), errors.TEMPORAL),
]

AUTHORITIES = [Rule("authority_blank", _blank("authority_id", "principal_id", "role"), errors.AUTHORITY)]

DECISIONS = [
    Rule("text_blank", _blank("subject_key", "rationale", "policy_id")),
    Rule("authority_scope_differs", _sql(_SCOPE_DIFFERS), errors.AUTHORITY_SCOPE),
    _instant("decided_at"),
    Rule("before_input", _sql("decided_at < input_as_of"), errors.TEMPORAL),
    *_members("evidence"),
]

APPROVALS = [
    Rule("decision_blank", _blank("decision_id"), errors.AUTHORITY),
    Rule("not_permitted", _sql("not may_approve_actions"), errors.AUTHORITY),
    _instant("approved_at"),
    *_members("evidence", errors.AUTHORITY),
    Rule("not_recommended", _sql("outcome <> 'recommend'"), errors.AUTHORITY),
    Rule("other_decision", _sql("approved_decision_id <> decision_id"), errors.AUTHORITY),
    Rule("authority_scope_differs", _sql(_SCOPE_DIFFERS), errors.AUTHORITY_SCOPE),
    Rule("before_decision", _sql("approved_at < decided_at"), errors.TEMPORAL),
]

ACTIONS = [
    Rule("kind_blank", _blank("action_kind")),
    Rule("idempotency_blank", _blank("idempotency_key"), errors.IDEMPOTENCY),
    _instant("attempted_at"),
    Rule("before_approval", _sql("attempted_at < approved_at"), errors.TEMPORAL),
    Rule("completed_before_attempt", _sql("completed_at < attempted_at"), errors.TEMPORAL),
    *_members("evidence"),
    Rule("reference_blank", _blank_if_present("external_reference")),
    Rule(
        "attempt_with_outcome",
        _sql("status = 'attempted' and (completed_at is not null or failure_reason is not null)"),
    ),
    Rule("completion_missing", _sql("status <> 'attempted' and completed_at is null")),
    Rule("reason_missing", _sql("status = 'failed' and coalesce(failure_reason, '') = ''")),
    Rule("reason_unexpected", _sql("status <> 'failed' and failure_reason is not null")),
]

RUNS = [Rule("run_missing", _empty("run_id")), _instant("started_at")]

COMPONENTS = [
    Rule("component_missing", _empty("component_name", "implementation_version")),
    Rule(
        "model_incomplete",
        lambda: (F.col("component_kind") == "model") & _empty("model_provider", "model_id", "model_revision")(),
    ),
]

TRANSFORMATION_EVENTS = [
    Rule("event_type_missing", _empty("event_type")),
    Rule("outputs_missing", _sql("outputs_count = 0")),
    Rule("edge_target_missing", _sql("empty_targets > 0")),
]

PROJECTION_REQUESTS = [
    Rule("request_incomplete", _empty("projection_id", "implementation_version", "config_digest")),
    _instant("requested_at"),
]

PROJECTION_MANIFESTS = [
    _instant("source_as_of", "recorded_at"),
    Rule("reason_missing", _sql("status = 'failed' and coalesce(failure_reason, '') = ''")),
    Rule("reason_unexpected", _sql("status <> 'failed' and failure_reason is not null")),
]

HITS = [Rule("score_out_of_range", _sql("score is null or isnan(score) or not (score > 0 and score <= 1)"))]

REQUEST_CONTEXTS = [
    Rule(
        "context_incomplete", _empty("principal_id", "tenant_id", "project_id", "site_id", "trace_id"), errors.SCOPE
    )
]

SCOPES = [Rule("scope_incomplete", _empty(*SCOPE), errors.SCOPE)]

POLICIES = [
    Rule("policy_blank", _blank("policy_id")),
    Rule("tolerance_invalid", _not_quantity("tolerance")),
]

DETECTOR_INPUTS = [
    Rule("quantity_invalid", _not_quantity("expected_quantity", "observed_quantity")),
    Rule("revision_blank", _blank("expected_revision", "observed_revision")),
    Rule("mention_blank", _blank("mention")),
]

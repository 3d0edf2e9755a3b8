from __future__ import annotations

from decimal import Decimal

import pytest

from fixtures import SCOPE_VALUES, day, expected_id
from ledgerline.operators.record_ids import RECORDS, with_record_id

PRINTED = "StateScope(tenant_id='tenant', project_id='project', site_id='site', version='bom-v1')"
ISO = "2026-01-02T00:00:00+00:00"

CASES = {
    "entity-mention": (dict(text="m", entity_type="sku", assertions_json='["a"]', observed_at=day(2)), ["m", "sku", ["a"], PRINTED, ISO]),
    "canonicalized-assertion": (dict(assertion_id="a", decision_id="d", effective_at=day(2)), ["a", "d", PRINTED, ISO]),
    "reconciliation-decision": (
        dict(subject_key="s", status="conflict", governing_json='["g"]', losing_json=None, policy_id="p", rationale="r", provenance_id="v"),
        ["s", "conflict", ["g"], [], "p", "r", "v"],
    ),
    "derived-fact": (
        dict(subject_key="s", predicate="p", value_text="4", as_of=day(2), evidence_json='["e"]', states_json='["t"]', provenance_id="v", unit=None),
        ["s", "p", "4", PRINTED, ISO, ["e"], ["t"], "v", None],
    ),
    "prediction-input": (dict(as_of=day(2), evidence_json='["e"]', states_json=None), [PRINTED, ISO, ["e"], []]),
    "prediction": (
        dict(subject_key="s", outcome="o", value_text="x", confidence=Decimal("0.5"), uncertainty_basis="b", as_of=day(2), horizon_start=day(2),
             horizon_end=day(2), evidence_json='["e"]', input_id="i", provenance_id="v", unit="d"),
        ["s", "o", "x", "0.5", "b", PRINTED, ISO, ISO, ISO, ["e"], "i", "v", "d"],
    ),
    "decision-input": (dict(as_of=day(2), facts_json='["f"]', anomalies_json='["a","b"]', predictions_json=None), [PRINTED, ISO, ["f"], ["a", "b"], []]),
    "decision": (
        dict(subject_key="s", outcome="defer", rationale="r", policy_id="p", authority_id="a", input_id="i", evidence_json='["e"]', decided_at=day(2), provenance_id="v"),
        ["s", "defer", "r", "p", "a", "i", ["e"], ISO, "v"],
    ),
    "action-approval": (dict(decision_id="d", authority_id="a", approved_at=day(2), evidence_json='["e"]'), ["d", "a", ISO, ["e"]]),
    "action-result": (
        dict(decision_id="d", approval_id="a", action_kind="k", idempotency_key="i", status="attempted", attempted_at=day(2), completed_at=None,
             external_reference=None, failure_reason=None, evidence_json='["e"]', provenance_id="v"),
        ["d", "a", "k", "i", "attempted", ISO, None, None, None, ["e"], "v"],
    ),
    "structured-document": (dict(artifact_id="a", elements_json='["x","y"]', provenance_id="v"), ["a", ["x", "y"], "v"]),
    "mapped-document": (dict(document_id="d", mapping_schema="m", fields_json='["f"]', provenance_id="v"), ["d", "m", ["f"], "v"]),
    "normalized-observation": (
        dict(observation_key="o", subject_hint="s", predicate="p", value_text=None, unit=None, field_key="f", effective_at=day(2), status="unresolved", provenance_id="v"),
        ["o", "s", "p", None, None, "f", PRINTED, ISO, "unresolved", "v"],
    ),
}


def ddl(value):
    if isinstance(value, Decimal):
        return "decimal(9,4)"
    return "string" if value is None or isinstance(value, str) else "timestamp"


def test_every_record_has_a_case():
    assert set(CASES) == set(RECORDS)


@pytest.mark.parametrize("namespace", sorted(CASES))
def test_record_id(spark, namespace):
    columns, parts = CASES[namespace]
    row = {**SCOPE_VALUES, **columns}
    schema = ", ".join(f"{k} {'timestamp' if k == 'completed_at' else ddl(v)}" for k, v in row.items())
    df = spark.createDataFrame([tuple(row.values())], schema)
    assert with_record_id(df, namespace, "rid").first().rid == expected_id(namespace, *parts)

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fixtures import SCOPE_VALUES, day, expected_id, operational
from ledgerline.errors import ContractError
from ledgerline.functions import instant_text
from ledgerline.operators import anomalies, governed, state
from ledgerline.operators.anomalies import Policy, StatePolicies

SCOPE_DDL = "tenant_id string, project_id string, site_id string, version string, "


def expected(spark, rows):
    made = [(*dict(SCOPE_VALUES, project_id=p).values(), k, Decimal(q), t) for k, q, t, p in rows]
    return spark.createDataFrame(made, SCOPE_DDL + "canonical_key string, required_quantity decimal(20,6), as_of timestamp")


def observed(spark, rows):
    """(key, ordered, received, substituted, unknown, freshness, as_of, project)"""
    made = [
        (*dict(SCOPE_VALUES, project_id=p).values(), k, *[Decimal(x) for x in (o, r, s, 0, u)], f, t, i)
        for i, (k, o, r, s, u, f, t, p) in enumerate(rows)
    ]
    names = ", ".join(f"{n} decimal(18,6)" for n in state.OBSERVED_QUANTITIES)
    return spark.createDataFrame(made, SCOPE_DDL + f"canonical_key string, {names}, freshness string, as_of timestamp, input_ordinal bigint")


def at(n, month=1):
    return F.lit(day(n, month)).cast("timestamp")


def pair(spark, seen, required=4):
    return state.compare_expected_observed(
        expected(spark, [("GPU-A", required, day(1), "project")]), observed(spark, seen), at(2)
    )


def test_outstanding_and_freshness(spark):
    row = pair(spark, [("GPU-A", 4, 3, 0, 0, "partial", day(1), "project")]).first()
    assert (row.outstanding_quantity, row.freshness) == (1, "partial")
    row = pair(spark, []).first()
    assert (row.outstanding_quantity, row.freshness, row.observed) == (4, "unknown", None)
    over = pair(spark, [("GPU-A", 4, 5, 0, 0, "current", day(1), "project")]).first()
    assert over.outstanding_quantity == 0


def test_latest_observation_of_the_same_scope_up_to_the_cutoff(spark):
    seen = [
        ("GPU-A", 1, 0, 0, 0, "current", day(1), "project"),
        ("GPU-A", 2, 0, 0, 0, "current", day(2), "project"),
        ("GPU-A", 9, 0, 0, 0, "current", day(2), "project"),
        ("GPU-A", 3, 0, 0, 0, "current", day(2), "other"),
        ("GPU-A", 4, 0, 0, 0, "current", day(3), "project"),
    ]
    assert pair(spark, seen).first().ordered_quantity == 2
    late = state.compare_expected_observed(
        expected(spark, [("GPU-A", 4, day(3), "project")]), observed(spark, seen), at(2)
    )
    assert late.count() == 0


def test_requirements_sum_all_sources(spark):
    lines = operational(spark, [("k", 1, 1, "a"), ("k", 2, 1, "b"), ("m", 5, None, "a")])
    rows = {r.canonical_key: r for r in state.expected_requirements(lines, at(1)).collect()}
    assert (rows["k"].required_quantity, rows["k"].evidence_count, rows["m"].required_quantity) == (3, 2, 5)


def kinds(df):
    return [(r.kind, r.expected, r.observed, r.severity) for r in df.collect()]


def found(spark, seen, policies=None, required=4):
    return anomalies.state_anomalies(pair(spark, seen, required), policies or StatePolicies(), at(2))


def test_missing_order_only_without_observation(spark):
    rows = found(spark, [])
    assert kinds(rows) == [("missing_po", 4, None, "warning")]
    assert rows.first().subject_key == "tenant/project/site/bom-v1:GPU-A"


def test_partial_order_raises_three_kinds_in_order(spark):
    rows = found(spark, [("GPU-A", 2, 1, 1, 1, "partial", day(1), "project")])
    assert kinds(rows) == [
        ("quantity_mismatch", 4, 2, "warning"),
        ("substitution", 0, 1, "warning"),
        ("coverage_gap", 4, 1, "info"),
    ]


def test_tolerances_are_strict(spark):
    seen = [("GPU-A", 1, 0, 0, 0, "current", day(1), "project")]
    one = StatePolicies(quantity_mismatch=Policy("q", Decimal(1)))
    assert [k[0] for k in kinds(found(spark, seen, one))] == ["quantity_mismatch"]
    three = StatePolicies(quantity_mismatch=Policy("q", Decimal(3)))
    assert kinds(found(spark, seen, three)) == []
    minimum = StatePolicies(missing_po=Policy("m", Decimal(4)))
    assert kinds(found(spark, [("GPU-A", 0, 0, 0, 0, "current", day(1), "project")], minimum)) == []
    flagless = StatePolicies(flag_non_current=False, quantity_mismatch=Policy("q", Decimal(9)))
    assert kinds(found(spark, [("GPU-A", 1, 0, 0, 0, "stale", day(1), "project")], flagless)) == []


def test_policies_are_checked():
    for bad in (("", 0), (" ", 0), ("p", -1), ("p", Decimal("NaN"))):
        with pytest.raises(ContractError):
            Policy(*bad)


def test_standalone_detectors(spark):
    numbers = spark.createDataFrame(
        [(1, Decimal(10), Decimal(12)), (2, Decimal(10), Decimal(13)), (3, Decimal(-1), Decimal(50))],
        "id int, expected decimal(18,6), observed decimal(18,6)",
    )
    two = Policy("p", Decimal(2))
    for detector, kind in ((anomalies.quantity_mismatch, "quantity_mismatch"), (anomalies.price_deviation, "price_deviation")):
        assert [(r.id, r.kind) for r in detector(numbers, two, at(1)).collect()] == [(2, kind)]
    dates = spark.createDataFrame([(1, day(1).date(), day(4).date()), (2, day(1).date(), day(5).date())], "id int, expected date, observed date")
    assert [r.id for r in anomalies.late_commitment(dates, Policy("p", 3), at(1)).collect()] == [2]
    texts = spark.createDataFrame([(1, "r1", "r1"), (2, "r1", "r2"), (3, " ", "r2")], "id int, expected string, observed string")
    assert [r.id for r in anomalies.stale_revision(texts, Policy("p"), at(1)).collect()] == [2]
    mentions = spark.createDataFrame([("x", "unresolved"), ("y", "resolved"), (" ", "unresolved")], "mention string, status string")
    assert [r.observed for r in anomalies.unresolved_identity(mentions, Policy("p"), at(1)).collect()] == ["x"]


def test_anomaly_identifier_sorts_evidence_and_ignores_the_rest(spark):
    raised = found(spark, [])
    keys = tuple(SCOPE_VALUES.values()) + ("GPU-A",)
    refs = ["evidence:" + c * 24 for c in "ba"]
    proof = spark.createDataFrame([(*keys, 0, i, r) for i, r in enumerate(refs)], SCOPE_DDL + "canonical_key string, side int, position bigint, evidence_id string")
    named = anomalies.anomaly_ids(raised, proof, F.lit("prov")).first()
    scope = "StateScope(tenant_id='tenant', project_id='project', site_id='site', version='bom-v1')"
    assert named.anomaly_id == expected_id(
        "anomaly", "tenant/project/site/bom-v1:GPU-A", scope, "missing_po", "4", "None", sorted(refs), "missing-po", "prov"
    )


def test_state_evidence_lists_each_id_once_requirement_first(spark):
    keys = tuple(SCOPE_VALUES.values()) + ("k",)
    ddl = SCOPE_DDL + "canonical_key string, position bigint, evidence_id string"
    left = spark.createDataFrame([(*keys, 1, "a"), (*keys, 2, "b")], ddl)
    right = spark.createDataFrame([(*keys, 1, "b"), (*keys, 2, "c")], ddl)
    rows = anomalies.state_evidence(left, right).orderBy("side", "position").collect()
    assert [r.evidence_id for r in rows] == ["a", "b", "c"]


def test_operational_state_marks_missing_values(spark):
    rolled = state.operational_state(state.state_attributes(pair(spark, []))).first()
    assert [a.name for a in rolled.attributes] == list(state.STATE_ATTRIBUTES)
    assert rolled.unresolved_count == 5 and rolled.attributes[0].value == 4
    facts = state.derived_facts(pair(spark, [])).first()
    assert (facts.value, facts.status) == (4, "inferred")


EVIDENCE_DDL = SCOPE_DDL + "canonical_key string, evidence_id string, side int"
PRINTED = "StateScope(tenant_id='tenant', project_id='{}', site_id='site', version='bom-v1')"


def evidenced(spark, rows):
    return spark.createDataFrame([(*SCOPE_VALUES.values(), *r) for r in rows], EVIDENCE_DDL)


def test_state_fact_and_bundle_ids_name_the_level_below(spark):
    pairs = pair(spark, [])
    row = pairs.first()
    key, when = row.canonical_key, pairs.select(instant_text(F.col("as_of")).alias("t")).first().t
    backing = evidenced(spark, [(key, "ev-2", 0), (key, "ev-1", 0)])
    made = governed.identified_states(state.state_attributes(pairs, unit="each"), backing, F.lit("prov")).cache()
    one = made.first()
    scope = PRINTED.format(row.project_id)
    values = [[a.name, None if a.value is None else f"{a.value.normalize():f}", a.status] for a in one.attributes]
    assert {a.unit for a in one.attributes} == {"each"} and one.evidence_count == 2
    assert one.state_id == expected_id(
        "operational-state", one.subject_key, scope, when, "unknown", values, ["ev-1", "ev-2"], "prov", None
    )
    facts = governed.outstanding_facts(made, F.lit("why"), "each")
    fact = facts.first()
    assert fact.value == 4 and fact.fact_id == expected_id(
        "derived-fact", one.subject_key, "outstanding_quantity", "4", scope, when, ["ev-1", "ev-2"], [one.state_id], "why", "each"
    )
    items = facts.select(*state.SCOPE, F.lit("facts").alias("list"), F.col("fact_id").alias("item_id"), "as_of")
    bundle = governed.identified_bundles(items.union(items), "decision-input", F.lit("2030-01-01").cast("timestamp")).first()
    assert (bundle.facts_count, bundle.anomalies_count, bundle.predictions_count) == (1, 0, 0)
    assert bundle.input_id == expected_id("decision-input", scope, "2030-01-01T00:00:00+00:00", [fact.fact_id], [], [])
    assert governed.identified_bundles(items, "decision-input", F.lit("2000-01-01").cast("timestamp")).count() == 0
    assert governed.uncontained(facts, made, ["state_id"]).count() == 0
    assert governed.uncontained(facts, made.where("false"), ["state_id"]).count() == 1


def test_attributes_rest_on_the_side_that_gives_them(spark):
    pairs = pair(spark, [])
    key = pairs.first().canonical_key
    attributes = state.state_attributes(pairs)
    alone = governed.attribute_evidence(attributes, evidenced(spark, [(key, "a", 0), (key, "b", 0)]))
    assert {(r.name, r.evidence_count) for r in alone.collect()} == {(n, 2) for n in state.STATE_ATTRIBUTES}
    both = governed.attribute_evidence(attributes, evidenced(spark, [(key, "a", 0), (key, "b", 0), (key, "c", 1)]))
    assert {(r.name, r.evidence_count) for r in both.collect()} == {(n, 2 if n == "required_quantity" else 1) for n in state.STATE_ATTRIBUTES}
    assert governed.uncontained(attributes, evidenced(spark, []), [*SCOPE_VALUES, "canonical_key"]).count() == len(state.STATE_ATTRIBUTES)

from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import SCOPE_VALUES, bom, candidates, day
from ledgerline.errors import ContractError
from ledgerline.operators import metrics
from ledgerline.plans import stage_trace, worklists
from ledgerline.quality import rules
from ledgerline.quality.checks import split, valid_rows, violations, with_members, with_offenders, with_strays
from ledgerline.schemas import SCOPE


def po_line(**change):
    row = dict(line_id="l", item_key="i", unit="each", quantity=Decimal(1), unit_price=Decimal(2), currency="USD",
               boq_id=None, boq_line_id=None, boq_version=None)
    return {**row, **change}


PO_DDL = ("line_id string, item_key string, unit string, quantity decimal(18,6), unit_price decimal(18,6), currency string, "
          "boq_id string, boq_line_id string, boq_version string")


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, set()),
        ({"quantity": Decimal(-1)}, {"quantity_invalid"}),
        ({"unit_price": None}, {"price_invalid"}),
        ({"line_id": "\t "}, {"text_blank"}),
        *[({"currency": c}, {"currency_invalid"}) for c in ("usd", "US", "US1", "ÅBC", "USD\n", None)],
        ({"boq_id": "b"}, {"boq_reference_partial"}),
        ({"boq_id": "b", "boq_line_id": " ", "boq_version": "r"}, {"boq_reference_blank"}),
        ({"boq_id": "b", "boq_line_id": "l", "boq_version": "r"}, set()),
    ],
)
def test_purchase_order_lines(spark, change, broken):
    df = spark.createDataFrame([po_line(**change)], PO_DDL)
    good, bad = split(df, ["line_id"], rules.PO_LINES)
    assert {r.rule for r in bad.collect()} == broken
    assert good.count() == (0 if broken else 1)


def test_strict_validation_fails_the_job(spark):
    df = spark.createDataFrame([po_line(quantity=Decimal(-1))], PO_DDL)
    with pytest.raises(Exception, match="semantic_contract_violation"):
        valid_rows(df, rules.PO_LINES, strict=True).collect()


def test_over_receipt_is_legal_and_negative_is_not(spark):
    names = ["ordered_quantity", "received_quantity", "substituted_quantity", "delayed_quantity", "unknown_quantity"]
    ddl = "id int, canonical_key string, as_of timestamp, evidence_count int, " + ", ".join(f"{n} decimal(18,6)" for n in names)
    rows = [(1, "k", day(1), 1, Decimal(4), Decimal(5), Decimal(0), Decimal(0), Decimal(0)),
            (2, "k", day(1), 1, Decimal(4), Decimal(-5), Decimal(0), Decimal(0), None)]
    found = violations(spark.createDataFrame(rows, ddl), ["id"], rules.OBSERVED).collect()
    assert {(r.id, r.rule) for r in found} == {(2, "received_quantity_invalid"), (2, "unknown_quantity_invalid")}
    assert {r.error_code for r in found} == {"pil.input.semantic_contract_violation"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.decimals(min_value=-2, max_value=2, places=4), min_size=1, max_size=15))
def test_confidence_bounds(spark, values):
    base = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, confidence decimal(9,4)")
    rule = [r for r in rules.PREDICTIONS if r.name == "confidence_invalid"]
    assert {r.id for r in violations(base, ["id"], rule).collect()} == {i for i, v in enumerate(values) if not 0 <= v <= 1}


def test_member_facts(spark):
    owners = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "owner int, tag string")
    members = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "owner int, member string")
    rows = {r.owner: (r.m_count, r.m_distinct) for r in with_members(owners, members, ["owner"], "member", "m").collect()}
    assert rows == {1: (3, 2), 2: (1, 1), 3: (0, 0)}
    allowed = spark.createDataFrame([(1, "x"), (2, "q")], "owner int, member string")
    strays = with_strays(owners, members, allowed, ["owner"], "member", "m").collect()
    assert {r.owner: r.m_strays for r in strays} == {1: 1, 2: 1, 3: 0}
    offended = with_offenders(owners, members, ["owner"], "member = 'x' and tag = 'a'", "bad").collect()
    assert {r.owner: r.bad for r in offended} == {1: 2, 2: 0, 3: 0}


def test_worklist_keeps_review_section(spark):
    lines = bom(spark, [("GPU-A", "g", 4, 1), ("gpu a", "g", 1, 1), ("ZZ", "z", 9, 1)])
    rows = {(r.section, r.item): r for r in worklists.sku_worklist(lines, candidates(spark, "GPU-A"), ["bom.xlsx"]).collect()}
    item = rows[("item", "GPU-A")]
    assert (item.required_quantity, item.mentions, item.note) == (5, 2, "reconciled")
    assert rows[("review", "ZZ")].note == "no normalized candidate match"
    assert worklists.aliases(lines, candidates(spark, "GPU-A")).count() == 2


def test_scenario_invents_no_price(spark):
    prices = spark.createDataFrame(
        [("GPU-A", Decimal(100), day(1)), ("GPU-A", Decimal(90), day(3)), ("GPU-A", Decimal(70), day(9))],
        "canonical_key string, unit_price decimal(18,6), effective_at timestamp",
    )
    cutoff = F.lit(day(5)).cast("timestamp")

    def cost(rows):
        lines = worklists.scenario_lines(bom(spark, rows), candidates(spark, "GPU-A", "CPU"), prices, cutoff)
        return worklists.scenario_cost(lines).first()

    whole = cost([("GPU-A", "g", 4, None)])
    assert (whole.total, whole.status) == (360, "inferred")
    part = cost([("GPU-A", "g", 4, None), ("CPU", "c", 1, None), ("??x", "u", 1, None)])
    assert (part.total, part.priced_subtotal, part.missing_price_lines, part.unresolved_lines) == (None, 360, 1, 1)


def test_commitments(spark):
    promised = spark.createDataFrame([("a", day(10).date()), ("b", day(10).date()), ("c", day(10).date())], "commitment_id string, promised_date date")
    seen = spark.createDataFrame([("a", day(8).date()), ("b", day(9).date()), ("b", day(15).date())], "commitment_id string, observed_date date")
    rows = {r.commitment_id: (r.delay_status, r.days_late) for r in worklists.commitment_delays(promised, seen, 2).collect()}
    assert rows == {"a": ("on_time", -2), "b": ("late", 5), "c": ("open", None)}


def test_alias_candidates(spark):
    items = spark.createDataFrame([("i", "name", ["x", "name", "y"]), ("j", None, None)], "item_id string, description string, aliases array<string>")
    rows = sorted((r.canonical_key, r.candidate) for r in worklists.alias_candidates(items, "item_id", ["description"]).collect())
    assert rows == [("i", "i"), ("i", "name"), ("i", "x"), ("i", "y"), ("j", "j")]


def test_stage_trace_names_empty_results(spark):
    lines = bom(spark, [("A", "a", 1, 1)])
    rows = stage_trace.stage_trace(lines, {"INGEST": lines.select(*SCOPE)}).orderBy("stage_index").collect()
    assert len(rows) == 12 and rows[0].result == "executed" and rows[8].result == "no_anomalies"
    assert all(r.row_count == 0 for r in rows[1:])


def test_observed_run_counts_what_it_writes(spark):
    run = stage_trace.ObservedRun()
    assert run.stage("INGEST", spark.range(1000).repartition(7)).count() == 1000
    run.stage("ASSERT", spark.range(5))
    run.stage("ASSERT", spark.range(6))
    run.stage("RESOLVE", spark.range(10).where("id > 20"))
    run.stage("DETECT", spark.createDataFrame([], "a long"))
    rows = {r.stage: (r.row_count, r.result) for r in run.trace(spark).collect()}
    assert len(rows) == 12 and rows["INGEST"] == (1000, "executed") and rows["ASSERT"] == (11, "executed")
    assert rows["RESOLVE"] == (0, "no_resolution_decisions") and rows["DETECT"] == (0, "no_anomalies") and rows["ACT"] == (0, "no_action_attempted")
    with pytest.raises(ContractError):
        run.stage("GUESS", spark.range(1))


def test_metrics(spark):
    scope = SCOPE_VALUES["tenant_id"]
    decisions = spark.createDataFrame(
        [("a", "A", "x"), ("b", "Z", "x"), ("c", None, "ambiguous normalized"), ("d", None, "no")],
        "mention string, canonical_key string, rationale string",
    ).withColumn("tenant_id", F.lit(scope))
    gold = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", None)], "mention string, gold_key string")
    row = metrics.resolution_metrics(decisions, gold, ["tenant_id"], ["mention"]).first()
    assert (row.precision, row.false_merge_rate, row.review, row.gold) == (0.5, 0.5, 1, 3)
    assert row.recall == pytest.approx(1 / 3)
    hits = spark.createDataFrame([("q", "e1", 1), ("q", "e2", 2), ("q", "e3", 3)], "query_id string, entry_id string, rank int")
    judged = spark.createDataFrame([("q", "e1"), ("q", "e3"), ("q", "e9")], "query_id string, entry_id string")
    got = metrics.retrieval_metrics(hits, judged, 3).first()
    assert got.recall == pytest.approx(2 / 3) and got.ndcg == pytest.approx(1.5 / (1 + 0.6309297536 + 0.5), abs=1e-6)


def test_owner_join_is_complete_for_hot_and_cold_keys(spark):
    from ledgerline.operators.skew import hot_keys, join_owner

    members = spark.range(900).select(
        F.when(F.col("id") < 500, 1).otherwise((F.col("id") % 37) + 2).alias("owner"), F.col("id").alias("member")
    )
    owners = spark.createDataFrame([(i, f"tag{i}") for i in range(1, 30)], "owner bigint, tag string")
    got = sorted((r.owner, r.member, r.tag) for r in join_owner(members, owners, ["owner"], above=50).collect())
    want = sorted((r.owner, r.member, r.tag) for r in members.join(owners, "owner").collect())
    assert got == want and len(want) > 500
    counts = members.groupBy("owner").agg(F.count(F.lit(1)).alias("id_count"))
    assert [r.owner for r in hot_keys(counts, ["owner"], 50).collect()] == [1]

from __future__ import annotations

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fixtures import SCOPE_VALUES, bom, candidates, expected_id, operational
from ledgerline import errors
from ledgerline.errors import AccessDenied, ContractError
from ledgerline.operators import bom as bom_ops
from ledgerline.operators import claims, members, resolution, state
from ledgerline.operators.evidence import evidence_id
from ledgerline.operators.reconciliation import (
    checked_precedence,
    reconcile_lines,
    reconcile_single_source,
    reconciled_evidence,
    reconciled_sources,
    uncovered_keys,
)
from ledgerline.operators.scope import RequestContext, within
from ledgerline.plans.bom_run import run_bom, run_chain
from ledgerline.schemas import SCOPE

PRICED = [("GPU-A", "GPU accelerator", 4, 100), ("CPU-A", "CPU", 2, 50)]


def by_kind(df):
    return {r.kind: r for r in df.collect()}


def test_raw_questions(spark):
    lines = bom(spark, PRICED)
    assert sorted(r.sku for r in bom_ops.distinct_skus(lines).collect()) == ["CPU-A", "GPU-A"]
    assert bom_ops.keyword_quantity(lines).first().value == 4
    cost = bom_ops.bom_cost(lines).first()
    assert (cost.value, cost.status) == (500, "observed")


def test_missing_price_leaves_cost_unresolved(spark):
    row = bom_ops.bom_cost(bom(spark, [("GPU-A", "GPU", 1, None), ("B", "b", 1, 5)])).first()
    assert row.value is None and row.status == "unresolved"


def test_bill_of_unresolved_lines_is_observed_as_zero(spark):
    lines = bom(spark, [("GPU-A", "GPU", 1, None)]).withColumn("status", F.lit("unresolved"))
    cost, quantity = bom_ops.bom_cost(lines).first(), bom_ops.keyword_quantity(lines).first()
    assert (cost.value, cost.status, cost.evidence_count) == (0, "observed", 0)
    assert (quantity.value, quantity.status) == (0, "observed")
    assert bom_ops.distinct_skus(lines).count() == 0


def test_assertions_of_a_line(spark):
    lines = bom(spark, [("GPU-A", "GPU", 1, None), ("B", "b", "2.50", 5)])
    made = bom_ops.with_assertion_ids(bom_ops.bom_assertions(lines)).orderBy("line_no", "ordinal").collect()
    assert [(r.subject_key, r.predicate, r.value_text) for r in made] == [
        ("GPU-A", "has_sku", "GPU-A"),
        ("GPU-A", "has_description", "GPU"),
        ("GPU-A", "has_quantity", "1"),
        ("B", "has_sku", "B"),
        ("B", "has_description", "b"),
        ("B", "has_quantity", "2.5"),
        ("B", "has_unit_price", "5"),
    ]
    seen = expected_id("evidence", "bom.xlsx", "hash", "BOM", 2, ["A", "B", "C", "D"])
    assert made[0].assertion_id == expected_id("assertion", "GPU-A", "has_sku", "GPU-A", seen, "document", None)


@pytest.mark.parametrize(
    ("mention", "names", "want"),
    [
        ("gpu a", ["GPU-A", "CPU-A"], ("GPU-A", "resolved", "normalized exact identifier match")),
        ("GPU-A", ["GPU-A", "GPU A"], (None, "unresolved", "ambiguous normalized candidate match")),
        ("GPU-A", ["GPU-A", "GPU-A"], (None, "unresolved", "ambiguous normalized candidate match")),
        ("unknown", ["GPU-A"], (None, "unresolved", "no normalized candidate match")),
        ("--", ["GPU-A", "//"], ("//", "resolved", "normalized exact identifier match")),
    ],
)
def test_resolution(spark, mention, names, want):
    row = resolution.resolve_identifiers(bom(spark, [(mention, "d", 1, 1)]), candidates(spark, *names)).first()
    assert (row.canonical_key, row.status, row.rationale) == want
    assert row.evidence_count == 1


def test_decision_meets_lines_by_raw_identifier_and_the_last_one_wins(spark):
    lines = bom(spark, [("GPU-A", "x", 1, 1), ("gpu a", "x", 1, 1)])
    scope = tuple(SCOPE_VALUES.values())
    decisions = spark.createDataFrame(
        [(*scope, "GPU-A", "old", "resolved", 1), (*scope, "GPU-A", "new", "resolved", 2), (*scope, "zzz", "z", "resolved", 3)],
        "tenant_id string, project_id string, site_id string, version string, mention string, canonical_key string, status string, ordinal int",
    )
    rows = state.operational_lines(lines, decisions).collect()
    assert [(r.sku, r.canonical_key) for r in rows] == [("GPU-A", "new")]


def test_reconciliation_keeps_losing_claims(spark):
    lines = operational(spark, [("gpu", 4, 100, "a"), ("gpu", 2, 100, "b"), ("cpu", 1, 20, "a"), ("cpu", 1, 25, "b")])
    rows = {r.canonical_key: r for r in reconcile_lines(lines, ["a", "b"]).collect()}
    assert (rows["cpu"].unit_price, rows["cpu"].status) == (20, "conflict")
    assert (rows["gpu"].quantity, rows["gpu"].status) == (4, "conflict")
    assert all((r.evidence_count, r.losing_evidence_count, r.source_count) == (1, 1, 2) for r in rows.values())
    roles = reconciled_evidence(lines, reconcile_lines(lines, ["a", "b"])).collect()
    assert sorted((r.canonical_key, r.artifact_id, r.role) for r in roles) == [
        ("cpu", "a", "governing"),
        ("cpu", "b", "losing"),
        ("gpu", "a", "governing"),
        ("gpu", "b", "losing"),
    ]
    assert reconciled_sources(lines, ["a", "b"]).count() == 4


@pytest.mark.parametrize(
    ("rows", "price", "status"),
    [
        ([("k", 1, None, "a"), ("k", 2, None, "a")], None, "reconciled"),
        ([("k", 1, 100, "a"), ("k", 2, None, "a")], None, "conflict"),
        ([("k", 1, 100, "a"), ("k", 2, 120, "a")], None, "conflict"),
        ([("k", 1, 100, "a"), ("k", 2, 100, "a")], 100, "reconciled"),
        ([("k", 3, 100, "a"), ("k", 1, 100, "b"), ("k", 2, 100, "b")], 100, "reconciled"),
        ([("k", 3, None, "a"), ("k", 3, 100, "b")], None, "conflict"),
        ([("k", 3, None, "a"), ("k", 3, None, "b")], None, "reconciled"),
        ([("k", 3, None, "a"), ("k", 1, 5, "b"), ("k", 2, 6, "b")], None, "reconciled"),
    ],
)
def test_null_price_is_a_value(spark, rows, price, status):
    row = reconcile_lines(operational(spark, rows), ["a", "b"]).first()
    assert (row.unit_price, row.status) == (price, status)


def reference_reconcile(rows, precedence):
    """Brute force over plain tuples."""
    out = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        present = {r[3] for r in mine}
        chosen = next((s for s in precedence if s in present), None)
        if chosen is None:
            continue

        def signature(source):
            lines = [r for r in mine if r[3] == source]
            prices = {r[2] for r in lines}
            return sum(r[1] for r in lines), prices.pop() if len(prices) == 1 else None

        several = len({r[2] for r in mine if r[3] == chosen}) != 1
        conflict = several or any(signature(s) != signature(chosen) for s in present)
        out[key] = (*signature(chosen), chosen, "conflict" if conflict else "reconciled")
    return out


def test_reconciliation_equals_brute_force_in_any_order(spark):
    rng = random.Random(5)
    rows = [
        (f"k{rng.randrange(40)}", rng.randrange(1, 4), rng.choice([None, 10, 10, 10, 20]), rng.choice("abcz"))
        for _ in range(150)
    ]
    want = reference_reconcile(rows, ["b", "a", "c"])
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = reconcile_lines(operational(spark, rows).repartition(5), ["b", "a", "c"]).collect()
        assert {
            r.canonical_key: (int(r.quantity), None if r.unit_price is None else int(r.unit_price), r.governing_source_artifact, r.status)
            for r in got
        } == want


def test_sources_no_policy_covers(spark):
    lines = operational(spark, [("k", 1, 1, "x"), ("m", 1, 1, "a")])
    assert [r.canonical_key for r in reconcile_lines(lines, ["a"]).collect()] == ["m"]
    missed = uncovered_keys(lines, ["a"]).first()
    assert (missed.canonical_key, missed.category) == ("k", "policy")
    with pytest.raises(Exception, match="no_governing_source"):
        reconcile_lines(lines, ["a"], strict=True).collect()
    with pytest.raises(Exception, match="no_governing_source"):
        reconcile_single_source(lines).collect()
    for bad in ([], ["a", "a"]):
        with pytest.raises(ContractError):
            checked_precedence(bad)


def test_run_with_one_unknown(spark):
    lines = bom(spark, [("GPU-A", "GPU", 4, 100), ("UNKNOWN", "GPU", 8, 100)])
    run = run_bom(lines, candidates(spark, "GPU-A"))
    assert run.assertions.count() == 8
    assert {r.mention: r.status for r in run.decisions.collect()} == {"GPU-A": "resolved", "UNKNOWN": "unresolved"}
    assert [(r.canonical_key, r.quantity) for r in run.reconciled_lines.collect()] == [("GPU-A", 4)]
    chain = run_chain(lines, run.summary).first()
    assert [n.status for n in chain.nodes] == ["observed", "partially_resolved", "observed", "reconciled"]


def test_run_without_precedence_refuses_several_sources(spark):
    lines = bom(spark, [("GPU-A", "GPU", 1, 2, "a"), ("GPU-A", "GPU", 1, 2, "b")])
    run = run_bom(lines, candidates(spark, "GPU-A"))
    for table in (run.reconciled_lines, run.summary, run.claims):
        with pytest.raises(Exception, match=errors.NO_GOVERNING_SOURCE):
            table.collect()
    # a source without resolved lines needs no policy
    lines = bom(spark, [("GPU-A", "GPU", 1, 2, "a"), ("UNKNOWN", "GPU", 1, 2, "b")])
    assert by_kind(run_bom(lines, candidates(spark, "GPU-A")).claims)["gpu_quantity"].status == "unresolved"


def test_run_needs_the_permission_and_scope(spark):
    lines = bom(spark, PRICED).unionByName(bom(spark, PRICED, project_id="other"))
    allowed = RequestContext("me", "tenant", "project", "site", frozenset({"read_state"}))
    assert within(lines, allowed).count() == 2
    with pytest.raises(AccessDenied):
        run_bom(lines, candidates(spark, "GPU-A"), context=RequestContext("me", "tenant", "project", "site"))


def test_claims_are_conservative(spark):
    unresolved = run_bom(bom(spark, [("GPU-ALIAS", "GPU accelerator", 9, 1)]), candidates(spark, "GPU-A"))
    row = by_kind(unresolved.claims)["gpu_quantity"]
    assert (row.value, row.status) == (None, "unresolved")

    settled = by_kind(run_bom(bom(spark, PRICED), candidates(spark, "GPU-A", "CPU-A")).claims)
    assert {k: (r.value, r.status, r.evidence_count) for k, r in settled.items()} == {
        "distinct_skus": (None, "reconciled", 2),
        "gpu_quantity": (Decimal(4), "reconciled", 1),
        "bom_cost": (Decimal(500), "reconciled", 2),
    }
    assert settled["distinct_skus"].key_count == 2


def test_keyword_claim_sums_the_whole_key(spark):
    lines = bom(spark, [("GPU-A", "GPU accelerator", 4, 100), ("GPU-A", "spare part", 3, 100), ("CPU", "cpu", 1, None)])
    rows = by_kind(run_bom(lines, candidates(spark, "GPU-A", "CPU")).claims)
    assert rows["gpu_quantity"].value == 7
    assert (rows["bom_cost"].value, rows["bom_cost"].status) == (None, "unresolved")
    assert rows["distinct_skus"].status == "reconciled"


def test_unresolved_beats_conflict(spark):
    clash = [("GPU-A", "GPU", 1, 100, "a"), ("GPU-A", "GPU", 1, 125, "b")]
    rows = by_kind(run_bom(bom(spark, clash), candidates(spark, "GPU-A"), ["a", "b"]).claims)
    assert {r.status for r in rows.values()} == {"conflict"}
    rows = by_kind(run_bom(bom(spark, [*clash, ("ZZZ", "x", 1, 1, "a")]), candidates(spark, "GPU-A"), ["a", "b"]).claims)
    assert rows["bom_cost"].status == "unresolved" and rows["gpu_quantity"].status == "conflict"


def test_scope_without_lines_has_unresolved_claims(spark):
    scopes = bom(spark, PRICED, project_id="empty").select(*SCOPE).distinct()
    rows = claims.inspect_claims(bom(spark, PRICED).limit(0), candidates(spark, "GPU-A"), ["a"], scopes=scopes).collect()
    assert len(rows) == 3 and all(r.status == "unresolved" and r.value is None for r in rows)
    assert all(r.resolution_status == "partially_resolved" for r in rows)


def test_claim_identifiers(spark):
    lines = bom(spark, PRICED)
    keys = claims.reconciled_keys(lines, candidates(spark, "GPU-A", "CPU-A"), ["bom.xlsx"])
    made = claims.claims_from_summary(claims.scope_summary(keys))
    named = by_kind(claims.claim_ids(made, claims.claim_evidence(lines), claims.claim_keys(keys, made)))
    refs = [expected_id("evidence", "bom.xlsx", "hash", "BOM", n, ["A", "B", "C", "D"]) for n in (2, 3)]
    steps = [
        ("source_assertion", "source assertions", "observed"),
        ("resolution", "entity resolution", "resolved"),
        ("operational_state", "operational state", "observed"),
        ("reconciliation", "reconciliation", "reconciled"),
    ]
    for kind, value, cited in (
        ("distinct_skus", "('CPU-A', 'GPU-A')", refs),
        ("gpu_quantity", "4", refs[:1]),
        ("bom_cost", "500", refs),
    ):
        nodes = [expected_id("evidence-node", *step, cited) for step in steps]
        chain = expected_id("evidence-chain", kind, nodes)
        assert named[kind].entries == cited
        assert named[kind].chain_id == chain
        assert named[kind].claim_id == expected_id("claim", kind, value, "reconciled", chain, cited)
    shown = claims.review_context(claims.claim_ids(made, claims.claim_evidence(lines), claims.claim_keys(keys, made)))
    assert all(len(r.node_ids) == 4 and len(r.allowed_reasons) == 5 for r in shown.collect())


def run_id(entries):
    return expected_id("block", list(entries))


def entries_of(ids, fanout):
    while len(ids) > fanout:
        ids = [run_id(ids[i : i + fanout]) for i in range(0, len(ids), fanout)]
    return ids


@pytest.mark.parametrize("fanout", [1000, 3])
def test_lists_of_any_length_follow_one_rule(spark, monkeypatch, fanout):
    """Around one run, beyond it, and (with short runs) in many levels; null keys, repeated members and rows that tie."""
    monkeypatch.setattr(members, "FANOUT", fanout)
    sizes = {"a": 999, "b": 1000, "c": 1001, "d": 5000, "e": 1, None: 4}
    plain = {key: [f"evidence:{key}{i // 2}" for i in range(n)] for key, n in sizes.items()}
    rows = [(key, i // 3, value, 7) for key, values in plain.items() for i, value in enumerate(values)]
    frame = spark.createDataFrame(rows, "key string, n long, evidence_id string, member int").repartition(7, "n")
    found = {r.key: r for r in members.id_lists(frame, ["key"], ["n"]).collect()}
    assert set(found) == set(plain)
    for key in plain:
        ids = [e for _, e in sorted((n, e) for k, n, e, _ in rows if k == key)]
        assert found[key].id_count == len(ids)
        assert found[key].entries == entries_of(ids, fanout)
        assert found[key].ids_json == json.dumps(entries_of(ids, fanout), separators=(",", ":"))


def test_lists_tell_order_and_repetitions(spark):
    def root(values):
        frame = spark.createDataFrame(list(enumerate(values)), "n long, evidence_id string").withColumn("key", F.lit(1))
        return members.id_lists(frame, ["key"], ["n"]).first().ids_json

    values = [f"e{i}" for i in range(1100)]
    swapped = [*values[:7], values[8], values[7], *values[9:]]
    assert len({root(values), root(swapped), root([*values, "e5", "e5"]), root(values[:-1])}) == 4
    assert members.id_lists(spark.createDataFrame([], "key int, n long, evidence_id string"), ["key"], ["n"]).count() == 0


@pytest.mark.parametrize("name", ["purchase_order_ids", "entity_mention_ids", "claim_ids", "anomaly_ids", "source_chain"])
def test_identifiers_of_long_lists(spark, sf_dir, monkeypatch, name):
    """With runs of two members most lists are long; the check follows the same rule two levels deep."""
    import importlib

    import __spark_entry__ as contract
    from compare import connect, differences
    from ledgerline.registry import base

    monkeypatch.setattr(members, "FANOUT", 100)
    checks = dict(base.ORACLES)
    monkeypatch.setattr(base, "QUERIES", {})
    monkeypatch.setattr(base, "ORACLES", {})
    fresh = {}
    for part in ("bom", "ledger", "state"):
        spec = importlib.util.find_spec(f"ledgerline.registry.{part}")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        fresh |= base.ORACLES
    assert differences(contract.queries()[name](spark, sf_dir), connect(sf_dir), fresh[name]) == ""
    assert name == "purchase_order_ids" or fresh[name] != checks[name]


def test_review_of_claims_has_all_evidence(spark, sf_dir):
    from ledgerline.operators.scope import RequestContext
    from ledgerline.plans.claim_register import register_claims
    from ledgerline.registry.bom import KEYWORD, PRECEDENCE
    from ledgerline.sources.bindings import bind

    lines = bind(spark, sf_dir, "small_boms")
    made = register_claims(lines, bind(spark, sf_dir, "candidates"), PRECEDENCE, keyword=KEYWORD)
    shown = {(*(r[c] for c in SCOPE), r.claim_kind): r for r in claims.review_context(made).collect()}
    links = claims.review_evidence(made, claims.claim_evidence(lines, keyword=KEYWORD))
    cited = {}
    for r in links.orderBy("line_no", "evidence_id").collect():
        cited.setdefault(r.claim_id, []).append(r.evidence_id)
    for row in shown.values():
        assert row.evidence_entries == entries_of(cited.get(row.claim_id, []), members.FANOUT)
        assert row.evidence_count == len(cited.get(row.claim_id, []))
    one = next(iter(shown.values()))
    reviewer = RequestContext("r", one.tenant_id, one.project_id, one.site_id, frozenset({"review"}))
    seen = claims.review_context(made, context=reviewer).collect()
    assert seen and {(r.tenant_id, r.project_id, r.site_id) for r in seen} == {(one.tenant_id, one.project_id, one.site_id)}
    with pytest.raises(AccessDenied):
        claims.review_context(made, context=RequestContext("r", "t", "p", "s"))



def test_question_routes(spark):
    asked = [
        ("How many GPUs do we need?", "gpu_quantity"),
        ("gpu QUANTITY at what price", "gpu_quantity"),
        ("What is the gpu total-cost?", "bom_cost"),
        ("price of skus", "bom_cost"),
        ("Which SKUs?", "distinct_skus"),
        ("hello", None),
    ]
    scope = tuple(SCOPE_VALUES.values())
    questions = spark.createDataFrame(
        [(*scope, i, q) for i, (q, _) in enumerate(asked)],
        "tenant_id string, project_id string, site_id string, version string, id int, question string",
    )
    run = run_bom(bom(spark, PRICED), candidates(spark, "GPU-A", "CPU-A"))
    rows = claims.answer_questions(questions, run.claims).orderBy("id").collect()
    assert [r.kind for r in rows] == [k for _, k in asked]
    assert rows[0].value == 4 and rows[2].value == 500
    assert rows[-1].route_status == "unsupported"


@pytest.mark.parametrize("precedence", [["a", "b"], None])
def test_a_shared_run_gives_the_same_and_reads_its_lines_once(spark, tmp_path, precedence):
    rng = random.Random(3)
    sources = "ab" if precedence else "a"
    rows = [(f"{rng.choice(['GPU-A', 'gpu a', 'CPU-A', 'zzz'])}", rng.choice(["GPU x", "y"]), rng.randint(1, 9), rng.choice([None, 5, 7]), rng.choice(sources)) for _ in range(80)]
    path = str(tmp_path / "lines")
    bom(spark, rows).write.parquet(path)
    lines = spark.read.parquet(path)
    plain, shared = (run_bom(lines, candidates(spark, "GPU-A", "CPU-A"), precedence, share=share) for share in (False, True))
    for name in ("decisions", "reconciled_lines", "summary", "claims"):
        one, two = getattr(plain, name), getattr(shared, name)
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
        assert not [f for f in two.inputFiles() if path in f]
        if precedence:
            assert one._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2
    reference = reconcile_lines(shared.operational_lines, precedence) if precedence else reconcile_single_source(shared.operational_lines)
    assert sorted(map(str, reference.select(*shared.reconciled_lines.columns).collect())) == sorted(map(str, shared.reconciled_lines.collect()))


def test_evidence_lookup(spark):
    from ledgerline.operators.evidence import lookup_evidence

    lines = bom(spark, PRICED)
    ids = lines.select(evidence_id(lines.columns).alias("evidence_id")).limit(1)
    ids = ids.unionByName(spark.createDataFrame([("evidence:none",)], "evidence_id string"))
    found, missing = lookup_evidence(lines, ids)
    assert found.count() == 1 and [r.evidence_id for r in missing.collect()] == ["evidence:none"]


def test_scoped_tables_prune_by_scope_and_split_a_hot_project(spark, tmp_path):
    from ledgerline.sources.tables import write_scoped

    rows = spark.range(4000).select(
        F.lit("tenant").alias("tenant_id"),
        F.when(F.col("id") % 4 < 3, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 40).cast("string"))).alias("project_id"),
        F.lit("site").alias("site_id"),
        F.col("id"),
    )
    path = str(tmp_path / "t")
    write_scoped(rows, path, ["id"], partitions=4)
    assert len(list((tmp_path / "t" / "tenant_id=tenant" / "project_id=hot").glob("*.parquet"))) >= 2
    mine = within(spark.read.parquet(path), RequestContext("me", "tenant", "hot", "site", frozenset({"read_state"})))
    assert mine.count() == 3000
    assert "PartitionFilters: [isnotnull" in mine._jdf.queryExecution().executedPlan().toString()

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fixtures import day, expected_id
from ledgerline.errors import AccessDenied, ContractError
from ledgerline.operators import ledger, retrieval
from ledgerline.operators.scope import RequestContext

CONTEXT = RequestContext("me", "tenant", "project", "site", frozenset({"search"}))


def entries(spark, rows):
    df = spark.createDataFrame(
        [(i + 1, f"assertion:{i}", s, p, v, day(d)) for i, (s, p, v, d) in enumerate(rows)],
        "sequence bigint, assertion_id string, subject_key string, predicate string, value_text string, observed_at timestamp",
    )
    return df.withColumn("entry_id", ledger.entry_id())


BASIC = [("GPU-A", "has_quantity", "4", 1), ("GPU-B", "has_description", "GPU accelerator", 2)]


def ready(manifest):
    return manifest.first().asDict()


def build(spark, rows=BASIC, projection="p"):
    made = entries(spark, rows)
    at = F.lit(day(5)).cast("timestamp")
    return retrieval.build_index(made, projection), retrieval.build_manifest(made, projection, "1", "cfg", at, CONTEXT)


def test_sequences_are_dense_in_any_partitioning(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("hot"))
    numbered = ledger.dense_sequence(rows.repartition(7), ["hot", "id"], base=10, partitions=6).collect()
    want = sorted((r.hot, r.id) for r in numbered)
    assert [(r.hot, r.id) for r in sorted(numbered, key=lambda r: r.sequence)] == want
    assert sorted(r.sequence for r in numbered) == list(range(11, 1011))


def test_append_takes_each_assertion_once_and_continues_the_sequence(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = entries(spark, BASIC).select("assertion_id", "observed_at")
    ledger.write_entries(ledger.append_entries(first.unionByName(first), None), path)
    stored = ledger.read_ledger(spark, path)
    assert sorted(r.sequence for r in stored.collect()) == [1, 2]
    more = entries(spark, [*BASIC, ("C", "has_sku", "C", 1)]).select("assertion_id", "observed_at")
    added = ledger.append_entries(more, stored, ledger.last_sequence(stored))
    assert [(r.assertion_id, r.sequence) for r in added.collect()] == [("assertion:2", 3)]


def test_as_of_is_inclusive_and_keeps_sequences(spark):
    made = entries(spark, [("a", "p", "8", 3), ("a", "p", "4", 1)])
    rows = ledger.in_order(ledger.as_of(made, F.lit(day(1)).cast("timestamp"))).collect()
    assert [(r.sequence, r.value_text) for r in rows] == [(2, "4")]
    assert rows[0].entry_id == expected_id("assertion-entry", 2, "assertion:1", "2026-01-01T00:00:00+00:00")


def test_search_scores_by_covered_terms(spark):
    index, manifest = build(spark)
    got = ready(manifest)
    hits = retrieval.search(index, got, "accelerator", CONTEXT).collect()
    assert len(hits) == 1 and hits[0].score == 1.0 and hits[0].projection_manifest_id == got["manifest_id"]
    assert [r.score for r in retrieval.search(index, got, "gpu GPU missing", CONTEXT).collect()] == [2 / 3, 2 / 3]
    both = retrieval.search(index, got, "gpu", CONTEXT).collect()
    assert [r.entry_id for r in both] == sorted(r.entry_id for r in both)
    assert retrieval.search(index, got, "gpu", CONTEXT, limit=1).count() == 1
    assert retrieval.search(index, got, "  ", CONTEXT).count() == 0


def test_search_checks_limit_readiness_permission_scope(spark):
    index, manifest = build(spark)
    got = ready(manifest)
    nobody = RequestContext("me", "tenant", "project", "site")
    elsewhere = RequestContext("me", "tenant", "other", "site", frozenset({"search"}))
    with pytest.raises(ContractError):
        retrieval.search(index, None, "x", nobody, limit=0)
    with pytest.raises(LookupError):
        retrieval.search(index, {**got, "status": "failed"}, "x", nobody)
    with pytest.raises(AccessDenied, match="may not"):
        retrieval.search(index, got, "x", nobody)
    with pytest.raises(AccessDenied, match="another scope"):
        retrieval.search(index, got, "", elsewhere)


def test_manifest_identity_and_lifecycle(spark):
    index, manifest = build(spark)
    got = ready(manifest)
    ids = [r.entry_id for r in entries(spark, BASIC).orderBy("sequence").collect()]
    assert got["manifest_id"] == expected_id(
        "projection-manifest", "p", "lexical", "1", "cfg", ids, "2026-01-02T00:00:00+00:00", "ready",
        "2026-01-05T00:00:00+00:00", "tenant", "project", "site", None,
    )
    failed = retrieval.next_manifest(manifest, "failed", F.lit(day(6)).cast("timestamp"), "broken")
    log = manifest.withColumn("write_seq", F.lit(1)).unionByName(failed.withColumn("write_seq", F.lit(2)))
    assert retrieval.latest_manifests(log).first().status == "failed"
    assert retrieval.live_index(index, log).count() == 0
    again = log.unionByName(manifest.withColumn("write_seq", F.lit(3)))
    assert retrieval.live_index(index, again).count() == 2
    for status, reason in (("failed", None), ("deleted", "why")):
        with pytest.raises(ContractError):
            retrieval.next_manifest(manifest, status, F.lit(day(6)).cast("timestamp"), reason)
    with pytest.raises(ContractError):
        retrieval.build_manifest(entries(spark, BASIC), "p", "1", "c", F.lit(day(1)), CONTEXT, kind="vector")


def test_empty_projection_is_dated_by_its_request(spark):
    none = entries(spark, BASIC).limit(0)
    row = retrieval.build_manifest(none, "p", "1", "cfg", F.lit(day(5)).cast("timestamp"), CONTEXT).first()
    assert (row.source_entry_count, row.source_as_of, row.status) == (0, day(5), "ready")


def test_batch_search_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["gpu", "GPU-1", "gpu-12", "4", "24", "é-Ü", "cable", "a", "ca", "has_sku"]
    rows = [(rng.choice(words), rng.choice(words), f"{rng.choice(words)} {rng.choice(words)}", 1) for _ in range(120)]
    queries = [("q1", "gpu 4"), ("q2", "A a ca"), ("q3", "É"), ("q4", ""), ("q5", "zzz"), ("q6", "gpu-1 has_sku cable 2")]
    index, _ = build(spark, rows)
    got = retrieval.search_batch(index, spark.createDataFrame(queries, "query_id string, query string"), limit=7).collect()
    texts = {r.entry_id: r.text for r in index.collect()}
    for query_id, query in queries:
        terms = query.casefold().split()
        scored = [(-sum(t in text for t in terms) / len(terms), e) for e, text in texts.items()] if terms else []
        want = [(e, -s) for s, e in sorted(x for x in scored if x[0] < 0)[:7]]
        mine = sorted((r.rank, r.entry_id, r.score) for r in got if r.query_id == query_id)
        assert [(e, pytest.approx(s)) for _, e, s in mine] == want


def test_lists_of_common_terms_stay_closed(spark, monkeypatch):
    """Queries of common terms end with the first range; rare terms are read on, and results equal a scan."""
    rows = [(f"entry-{i:05}", f"common thing n{i} {'odd' if i % 701 == 5 else 'even'}") for i in range(2000)]
    index = spark.createDataFrame(rows, "entry_id string, text string").repartition(5)
    queries = [("c", "common thing"), ("d", "thing"), ("r", "odd common"), ("x", "thing odd n1999"), ("n", "n77 nowhere")]
    opened = []
    real = retrieval.open_terms

    def watched(plan, best, limit):
        state = real(plan, best, limit)
        opened.append({(r.query_id, r.term) for r in state.where("open").collect()})
        return state

    monkeypatch.setattr(retrieval, "open_terms", watched)
    got = retrieval.search_batch(index, spark.createDataFrame(queries, "query_id string, query string"), limit=5).collect()
    assert len(opened[0]) == 10
    for later in opened[1:]:
        assert not {q for q, _ in later} & {"c", "d"}
    assert ("r", "common") not in opened[1] | opened[2] and ("r", "odd") in opened[2]
    for query_id, query in queries:
        terms = query.split()
        scored = sorted((-sum(t in text for t in terms) / len(terms), e) for e, text in rows)
        want = [(e, -s) for s, e in scored if s < 0][:5]
        assert [(r.entry_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == query_id] == want

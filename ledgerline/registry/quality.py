"""Validation queries: violation counts per rule over tables with planted faults.

A table is plain SQL over the test tables in which some keys are damaged. Its check counts the same
faults with conditions written out in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import errors
from ledgerline.quality import rules
from ledgerline.quality.checks import Rule, violations, with_members, with_offenders, with_strays
from ledgerline.registry.base import query
from ledgerline.sources.bindings import inline, run_sql


@dataclass(frozen=True)
class Facts:
    """Member facts of an owner table: SQL of (owner, member), optionally of the allowed members.

    With an offence, the fact is the number of members that commit it against their owner.
    """

    prefix: str
    sql: str
    allowed: str | None = None
    offence: str | None = None


# members of orders: evidence (some repeated), with every fiftieth order left without
EVIDENCE = "SELECT l_orderkey AS owner, 'ev-'||CAST(l_partkey % 40 AS STRING) AS member FROM lineitem WHERE l_orderkey % 50 <> 3"
AVAILABLE = "SELECT l_orderkey AS owner, 'ev-'||CAST(l_partkey % 40 AS STRING) AS member FROM lineitem WHERE l_orderkey % 50 <> 3 AND l_linenumber <> 7"
LINES = "SELECT l_orderkey AS owner, 'line-'||CAST(l_linenumber AS STRING) AS member FROM lineitem WHERE l_orderkey % 60 <> 5"
STATES = "SELECT l_orderkey AS owner, CASE WHEN l_partkey % 500 = 1 THEN ' ' ELSE 'state-'||CAST(l_partkey % 60 AS STRING) END AS member FROM lineitem WHERE l_orderkey % 45 <> 2"

# lines that refer to a bill of some revision; members with a time and a site of their own
LINE_VERSIONS = "SELECT l_orderkey AS owner, CASE WHEN l_partkey % 200 = 3 THEN 'r3' WHEN l_orderkey % 2 = 0 THEN 'r1' ELSE 'r2' END AS boq_version FROM lineitem"
DATED = "SELECT l_orderkey AS owner, CAST(l_shipdate AS TIMESTAMP) AS member_time, CASE WHEN l_partkey % 300 = 4 THEN 'site-2' ELSE 'site-1' END AS member_site FROM lineitem"
SUBJECTS = "SELECT l_orderkey AS owner, CASE WHEN l_partkey % 400 = 5 THEN 'other' ELSE 's' END AS member FROM lineitem"
SITES = "SELECT l_orderkey AS owner, CASE WHEN l_partkey % 300 = 4 THEN 'site-2' ELSE 'site-1' END AS member FROM lineitem"

BLANK = "trim({0}) = ''"
EMPTY = "({0} IS NULL OR {0} = '')"
NONE = "{0} IS NULL"
BAD = "({0} IS NULL OR {0} < 0)"


def members(prefix: str) -> dict[str, str]:
    return {f"{prefix}_missing": f"{prefix}_count = 0", f"{prefix}_repeated": f"{prefix}_distinct < {prefix}_count"}


def validation(
    name: str, table_rules: list[Rule], sql: str, expect: dict[str, str], facts: tuple[Facts, ...] = ()
) -> None:
    """Register `validate_<name>`; the check must name every rule."""
    names = [rule.name for rule in table_rules]
    if sorted(names) != sorted(expect):
        raise ValueError(f"{name}: checks do not match rules {set(names) ^ set(expect)}")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = run_sql(spark, sf, inline(sql))
        for fact in facts:
            linked = run_sql(spark, sf, inline(fact.sql))
            if fact.offence:
                rows = with_offenders(rows, linked, ["owner"], fact.offence, fact.prefix)
                continue
            rows = with_members(rows, linked, ["owner"], "member", fact.prefix)
            if fact.allowed:
                allowed = run_sql(spark, sf, inline(fact.allowed)).select("owner", "member")
                rows = with_strays(rows, linked, allowed, ["owner"], "member", fact.prefix)
        found = violations(rows, [], table_rules)
        return found.groupBy("rule", "error_code", "category").agg(F.count(F.lit(1)).alias("violations"))

    steps = [f"t0 AS ({sql})"]
    for i, fact in enumerate(facts):
        p = fact.prefix
        steps.append(f"f{i} AS ({fact.sql})")
        if fact.offence:
            steps.append(
                f"t{i + 1} AS (SELECT t.*, (SELECT count(*) FROM f{i} WHERE f{i}.owner = t.owner AND ({fact.offence})) AS {p} FROM t{i} t)"
            )
            continue
        extra, join = "", ""
        if fact.allowed:
            steps.append(
                f"s{i} AS (SELECT owner, count(DISTINCT member) AS n FROM f{i} WHERE (owner, member) NOT IN ({fact.allowed}) GROUP BY owner)"
            )
            extra, join = f", coalesce(s.n, 0) AS {p}_strays", f" LEFT JOIN s{i} s ON s.owner = t.owner"
        steps.append(
            f"""t{i + 1} AS (SELECT t.*, coalesce(c.n, 0) AS {p}_count, coalesce(c.d, 0) AS {p}_distinct{extra} FROM t{i} t
LEFT JOIN (SELECT owner, count(*) AS n, count(DISTINCT member) AS d FROM f{i} GROUP BY owner) c ON c.owner = t.owner{join})"""
        )
    codes = {rule.name: rule.code for rule in table_rules}
    counts = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, '{codes[rule]}' AS error_code, '{errors.category_of(codes[rule])}' AS category, "
        f"count(*) AS violations FROM t{len(facts)} WHERE {condition}"
        for rule, condition in expect.items()
    )
    query(f"validate_{name}", f"WITH {', '.join(steps)} SELECT * FROM ({counts}) WHERE violations > 0")(run)


validation(
    "evidence",
    rules.EVIDENCE,
    """SELECT CASE WHEN l_partkey % 100 = 1 THEN '  ' ELSE 'doc' END AS artifact_id, 'h' AS content_hash,
CASE WHEN l_linenumber % 2 = 0 THEN 'tabular' ELSE 'record' END AS location_kind,
CASE WHEN l_partkey % 100 <> 2 THEN 'BOM' ELSE '' END AS sheet, l_linenumber - 2 AS "row",
CASE l_partkey % 100 WHEN 3 THEN '' WHEN 4 THEN 'A,B,A' WHEN 5 THEN 'A,,C' ELSE 'A,B' END AS cells,
'lineitem' AS collection, CASE WHEN l_partkey % 100 <> 6 THEN 'k' END AS record_key FROM lineitem""",
    {
        "source_missing": BLANK.format("artifact_id"),
        "sheet_missing": "location_kind = 'tabular' AND sheet = ''",
        "row_not_positive": "location_kind = 'tabular' AND \"row\" < 1",
        "cells_missing": "location_kind = 'tabular' AND cells IN ('', 'A,,C')",
        "cells_repeated": "location_kind = 'tabular' AND cells = 'A,B,A'",
        "record_missing": "location_kind = 'record' AND record_key IS NULL",
    },
)
validation(
    "results",
    rules.RESULTS,
    "SELECT CASE WHEN l_partkey % 10 < 3 THEN 'unresolved' ELSE 'observed' END AS status, CASE WHEN l_partkey % 10 > 0 THEN l_quantity END AS value FROM lineitem",
    {"unresolved_with_value": "status = 'unresolved' AND value IS NOT NULL"},
)
validation(
    "boq_lines",
    rules.BOQ_LINES,
    """SELECT CASE WHEN l_orderkey % 500 = 1 THEN ' ' ELSE 'l' END AS line_id, CASE WHEN l_orderkey % 500 = 2 THEN '' ELSE 'i' END AS item_key,
CASE WHEN l_orderkey % 500 <> 3 THEN 'd' ELSE '   ' END AS description, CASE WHEN l_orderkey % 500 = 4 THEN ' ' ELSE 'each' END AS unit,
CASE l_orderkey % 500 WHEN 5 THEN CAST(-1 AS DECIMAL(18,6)) WHEN 6 THEN NULL ELSE CAST(l_quantity AS DECIMAL(18,6)) END AS quantity FROM lineitem""",
    {
        "line_id_blank": BLANK.format("line_id"),
        "item_key_blank": BLANK.format("item_key"),
        "description_blank": BLANK.format("description"),
        "unit_blank": BLANK.format("unit"),
        "quantity_invalid": BAD.format("quantity"),
    },
)
validation(
    "boq",
    rules.BOQ,
    """SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 90 = 1 THEN '' ELSE boq_number END AS boq_number, revision,
CASE WHEN o_orderkey % 90 = 2 THEN 'r9' ELSE version END AS version, CASE WHEN o_orderkey % 90 <> 3 THEN as_of END AS as_of FROM {boq}""",
    {
        "number_blank": BLANK.format("boq_number"),
        "revision_differs": "version <> revision",
        "instant_missing": NONE.format("as_of"),
        **members("lines"),
    },
    (Facts("lines", LINES),),
)
validation(
    "po_lines",
    rules.PO_LINES,
    """SELECT CASE WHEN l_orderkey % 300 = 1 THEN ' ' ELSE line_id END AS line_id, item_key, unit,
CASE WHEN l_orderkey % 300 = 2 THEN -quantity ELSE quantity END AS quantity, CASE WHEN l_orderkey % 300 <> 3 THEN unit_price END AS unit_price,
CASE l_orderkey % 300 WHEN 4 THEN 'usd' WHEN 5 THEN 'US' WHEN 6 THEN 'US1' WHEN 7 THEN 'ÅBC' WHEN 8 THEN 'USDX' ELSE currency END AS currency,
CASE WHEN l_orderkey % 300 = 9 AND boq_id IS NOT NULL THEN ' ' ELSE boq_id END AS boq_id, CASE WHEN l_orderkey % 300 <> 10 THEN boq_line_id END AS boq_line_id,
CASE WHEN boq_id IS NOT NULL THEN version END AS boq_version FROM {po_lines}""",
    {
        "text_blank": BLANK.format("line_id"),
        "quantity_invalid": BAD.format("quantity"),
        "price_invalid": BAD.format("unit_price"),
        "currency_invalid": "currency <> 'USD'",
        "boq_reference_partial": "(boq_id IS NULL) <> (boq_line_id IS NULL) OR (boq_id IS NULL) <> (boq_version IS NULL)",
        "boq_reference_blank": "boq_id = ' '",
    },
)
validation(
    "purchase_orders",
    rules.PURCHASE_ORDERS,
    """SELECT o_orderkey AS owner, order_number, CASE WHEN o_orderkey % 80 = 1 THEN '  ' ELSE supplier_key END AS supplier_key,
CASE WHEN o_orderkey % 80 <> 2 THEN issued_at END AS issued_at, version FROM {purchase_orders}""",
    {
        "number_blank": BLANK.format("supplier_key"),
        "instant_missing": NONE.format("issued_at"),
        **members("lines"),
        "boq_scope_differs": "foreign_lines > 0",
    },
    (Facts("lines", LINES), Facts("foreign_lines", LINE_VERSIONS, offence="boq_version <> version")),
)
validation(
    "expected_requirements",
    rules.EXPECTED,
    """SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 70 = 1 THEN '' ELSE 'k' END AS canonical_key,
CAST(CASE WHEN o_orderkey % 70 = 2 THEN -1 ELSE 1 END AS DECIMAL(18,6)) AS required_quantity,
CASE WHEN o_orderkey % 70 <> 4 THEN CAST(o_orderdate AS TIMESTAMP) END AS as_of FROM orders""",
    {
        "key_missing": EMPTY.format("canonical_key"),
        "quantity_invalid": BAD.format("required_quantity"),
        "instant_missing": NONE.format("as_of"),
        "evidence_missing": "evidence_count = 0",
    },
    (Facts("evidence", EVIDENCE),),
)
_QUANTITIES = ("ordered_quantity", "received_quantity", "substituted_quantity", "delayed_quantity", "unknown_quantity")
validation(
    "observed_procurement",
    rules.OBSERVED,
    "SELECT CASE WHEN input_ordinal % 90 <> 1 THEN canonical_key END AS canonical_key, CASE WHEN input_ordinal % 90 <> 2 THEN as_of END AS as_of, "
    "CASE WHEN input_ordinal % 90 = 3 THEN 0 ELSE 1 END AS evidence_count, "
    + ", ".join(f"CASE WHEN input_ordinal % 90 = {i + 10} THEN -1 - {q} ELSE {q} END AS {q}" for i, q in enumerate(_QUANTITIES))
    + " FROM {observed}",
    {
        "key_missing": EMPTY.format("canonical_key"),
        **{f"{q}_invalid": BAD.format(q) for q in _QUANTITIES},
        "instant_missing": NONE.format("as_of"),
        "evidence_missing": "evidence_count = 0",
    },
)
validation(
    "expected_observed_pairs",
    rules.PAIRS,
    """SELECT 'k' AS canonical_key, CASE l_partkey % 20 WHEN 1 THEN 'other' WHEN 2 THEN NULL ELSE 'k' END AS observed_key,
't' AS tenant_id, 'p' AS project_id, 's' AS site_id, 'r1' AS version, 't' AS observed_tenant_id, CASE WHEN l_partkey % 20 < 4 THEN 'q' ELSE 'p' END AS observed_project_id,
's' AS observed_site_id, CASE WHEN l_partkey % 20 = 7 THEN 'r2' ELSE 'r1' END AS observed_version FROM lineitem""",
    {
        "keys_differ": "observed_key <> canonical_key",
        "scopes_differ": "observed_key IS NOT NULL AND (observed_project_id <> 'p' OR observed_version <> 'r1')",
    },
)
validation(
    "assertions",
    rules.ASSERTIONS,
    "SELECT CASE event_id % 40 WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE subject_key END AS subject_key, CASE WHEN event_id % 40 <> 3 THEN 'document' END AS source_system FROM {event_assertions}",
    {"subject_missing": "subject_key = '' OR source_system IS NULL"},
)
validation(
    "ledger",
    rules.LEDGER,
    "SELECT sequence - 10 AS sequence, CASE WHEN event_id % 77 <> 1 THEN observed_at END AS observed_at FROM {event_ledger}",
    {"sequence_not_positive": "sequence < 1", "instant_missing": NONE.format("observed_at")},
)
validation(
    "entity_mentions",
    rules.MENTIONS,
    """SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 55 = 1 THEN '  ' ELSE 'm' END AS text, 'sku' AS entity_type,
CASE WHEN o_orderkey % 55 <> 2 THEN CAST(o_orderdate AS TIMESTAMP) END AS observed_at FROM orders""",
    {
        "text_blank": BLANK.format("text"),
        "assertions_missing": "assertion_count = 0",
        "instant_missing": NONE.format("observed_at"),
    },
    (Facts("assertion", EVIDENCE),),
)
validation(
    "resolution_decisions",
    rules.RESOLUTION_DECISIONS,
    """SELECT CASE WHEN l_partkey % 60 = 1 THEN '' ELSE 'm' END AS mention, 'why' AS rationale, CASE WHEN l_partkey % 3 = 0 THEN 'unresolved' ELSE 'resolved' END AS status,
CASE WHEN l_partkey % 60 = 2 THEN ' ' WHEN l_partkey % 60 = 3 OR l_partkey % 3 <> 0 THEN 'key' END AS canonical_key FROM lineitem""",
    {
        "text_blank": BLANK.format("mention"),
        "resolved_without_key": "status = 'resolved' AND (canonical_key IS NULL OR trim(canonical_key) = '')",
        "unresolved_with_key": "status = 'unresolved' AND canonical_key IS NOT NULL",
    },
)
validation(
    "canonicalized_assertions",
    rules.CANONICALIZED,
    """SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 40 = 1 THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN o_orderkey % 40 <> 2 THEN 'key' END AS canonical_key,
CASE WHEN o_orderkey % 40 <> 3 THEN CAST(o_orderdate AS TIMESTAMP) END AS effective_at FROM orders""",
    {
        "not_resolved": "status = 'unresolved'",
        "key_missing": NONE.format("canonical_key"),
        "subject_foreign": "subject_strays > 0",
        "instant_missing": NONE.format("effective_at"),
    },
    (Facts("subject", EVIDENCE, AVAILABLE),),
)
validation(
    "reconciliation_decisions",
    rules.RECONCILIATION_DECISIONS,
    """SELECT o_orderkey AS owner, 's' AS subject_key, CASE WHEN o_orderkey % 30 = 1 THEN ' ' ELSE 'p' END AS policy_id, 'why' AS rationale,
CASE o_orderstatus WHEN 'F' THEN 'reconciled' WHEN 'O' THEN 'conflict' ELSE 'unresolved' END AS status FROM orders""",
    {
        "text_blank": BLANK.format("policy_id"),
        "governing_missing": "status <> 'unresolved' AND governing_count = 0",
        "governing_unexpected": "status = 'unresolved' AND governing_count > 0",
        "assertions_repeated": "assertions_distinct < assertions_count",
        "subjects_differ": "foreign_subjects > 0",
        "scopes_differ": "scopes_distinct > 1",
    },
    (
        Facts("governing", EVIDENCE),
        Facts("assertions", LINES),
        Facts("scopes", SITES),
        Facts("foreign_subjects", SUBJECTS, offence="member <> subject_key"),
    ),
)
validation(
    "precedence_policies",
    rules.PRECEDENCE,
    "SELECT o_orderkey AS owner FROM orders",
    members("sources"),
    (Facts("sources", "SELECT l_orderkey AS owner, l_returnflag||l_linestatus AS member FROM lineitem WHERE l_orderkey % 20 <> 1"),),
)
validation(
    "state_attributes",
    rules.ATTRIBUTES,
    """SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 30 = 1 THEN ' ' ELSE 'quantity' END AS name, CASE o_orderkey % 30 WHEN 2 THEN ' ' WHEN 4 THEN NULL ELSE 'each' END AS unit,
CASE WHEN o_orderkey % 30 > 6 THEN o_totalprice END AS value, CASE WHEN o_orderkey % 30 IN (5, 6, 7) THEN 'unresolved' ELSE 'observed' END AS status FROM orders""",
    {
        "name_blank": BLANK.format("name"),
        "unit_blank": "unit = ' '",
        "missing_not_unresolved": "value IS NULL AND status = 'observed'",
        "unresolved_with_value": "value IS NOT NULL AND status = 'unresolved'",
        **members("evidence"),
    },
    (Facts("evidence", EVIDENCE),),
)
validation(
    "operational_states",
    rules.STATES,
    """SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 30 = 1 THEN ' ' ELSE 's' END AS subject_key, CASE WHEN o_orderkey % 30 <> 2 THEN CAST(o_orderdate AS TIMESTAMP) END AS as_of,
CASE o_orderkey % 30 WHEN 4 THEN '' WHEN 5 THEN 'rec' END AS reconciliation_id FROM orders""",
    {
        "subject_blank": BLANK.format("subject_key"),
        "instant_missing": NONE.format("as_of"),
        **members("attributes"),
        **members("evidence"),
        "evidence_incomplete": "evidence_strays > 0",
        "reconciliation_blank": "reconciliation_id = ''",
    },
    (Facts("attributes", LINES), Facts("evidence", EVIDENCE, AVAILABLE)),
)
validation(
    "derived_facts",
    rules.DERIVED_FACTS,
    """SELECT o_orderkey AS owner, 's' AS subject_key, CASE WHEN o_orderkey % 30 = 1 THEN '' ELSE 'p' END AS predicate, CASE WHEN o_orderkey % 30 <> 2 THEN o_totalprice END AS value,
CASE WHEN o_orderkey % 30 <> 4 THEN CAST(o_orderdate AS TIMESTAMP) END AS as_of, CASE WHEN o_orderkey % 30 = 5 THEN 'observed' ELSE 'inferred' END AS status,
CASE WHEN o_orderkey % 30 = 6 THEN ' ' END AS unit FROM orders""",
    {
        "subject_blank": BLANK.format("predicate"),
        "value_missing": NONE.format("value"),
        "instant_missing": NONE.format("as_of"),
        **members("evidence"),
        **members("states"),
        "state_id_blank": "blank_states > 0",
        "status_not_inferred": "status = 'observed'",
        "unit_blank": "unit = ' '",
    },
    (Facts("evidence", EVIDENCE), Facts("states", STATES), Facts("blank_states", STATES, offence="trim(member) = ''")),
)
_ORDER_SCOPE = "'t' AS tenant_id, 'p' AS project_id, 's' AS site_id, 'r1' AS version"
_INPUT_SCOPE = "'t' AS input_tenant_id, CASE WHEN o_orderkey % 30 = 8 THEN 'x' ELSE 'p' END AS input_project_id, 's' AS input_site_id, 'r1' AS input_version"
validation(
    "anomalies",
    rules.ANOMALIES,
    """SELECT o_orderkey AS owner, 's' AS subject_key, CASE WHEN o_orderkey % 30 = 1 THEN '' ELSE 'p' END AS policy_id, CASE WHEN o_orderkey % 30 <> 2 THEN CAST(o_orderdate AS TIMESTAMP) END AS detected_at,
't' AS tenant_id, CASE WHEN o_orderkey % 30 <> 4 THEN 'p' END AS project_id, 's' AS site_id, 'r1' AS version FROM orders""",
    {
        "subject_blank": BLANK.format("policy_id"),
        **members("evidence"),
        "instant_missing": NONE.format("detected_at"),
        "scope_missing": NONE.format("project_id"),
    },
    (Facts("evidence", EVIDENCE),),
)
validation(
    "source_references",
    rules.SOURCE_REFERENCES,
    """SELECT CASE WHEN doc_id % 20 = 1 THEN ' ' ELSE source END AS source_system, 'doc' AS source_uri, CASE WHEN doc_id % 20 <> 2 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) END AS observed_at,
CASE doc_id % 20 WHEN 3 THEN '' WHEN 4 THEN 'v1' END AS source_version FROM documents""",
    {
        "source_blank": BLANK.format("source_system"),
        "instant_missing": NONE.format("observed_at"),
        "version_blank": "source_version = ''",
    },
)
validation(
    "artifacts",
    rules.ARTIFACTS,
    """SELECT 'h' AS content_hash, CASE WHEN doc_id % 20 = 1 THEN '' ELSE 'text/plain' END AS media_type, CASE WHEN doc_id % 20 = 2 THEN -1 ELSE n_chars END AS byte_length,
CASE WHEN doc_id % 20 <> 3 THEN CAST('2024-01-05 00:00:00' AS TIMESTAMP) END AS captured_at,
CASE WHEN doc_id % 20 = 4 THEN CAST('2024-02-01 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-01 00:00:00' AS TIMESTAMP) END AS observed_at FROM documents""",
    {
        "content_blank": BLANK.format("media_type"),
        "length_negative": BAD.format("byte_length"),
        "instant_missing": NONE.format("captured_at"),
        "captured_before_observed": "captured_at < observed_at",
    },
)
validation(
    "structured_elements",
    rules.ELEMENTS,
    """SELECT CASE WHEN page_id % 20 = 1 THEN ' ' ELSE url END AS element_id, 'page' AS kind, CASE WHEN page_id % 20 = 2 THEN -1 ELSE page_id END AS ordinal, 'a' AS artifact_id,
CASE WHEN page_id % 20 = 3 THEN 'b' ELSE 'a' END AS evidence_artifact_id, 'h' AS content_hash, CASE WHEN page_id % 20 = 4 THEN 'g' ELSE 'h' END AS evidence_hash FROM pages""",
    {
        "text_blank": BLANK.format("element_id"),
        "ordinal_negative": "ordinal < 0",
        "evidence_foreign": "evidence_artifact_id = 'b' OR evidence_hash = 'g'",
    },
)
validation(
    "structured_documents",
    rules.STRUCTURED_DOCUMENTS,
    "SELECT o_orderkey AS owner FROM orders",
    {
        "element_ids_repeated": "elements_distinct < elements_count",
        "ordinals_repeated": "ordinals_distinct < ordinals_count",
    },
    (Facts("elements", EVIDENCE), Facts("ordinals", LINES)),
)
validation(
    "mapped_fields",
    rules.MAPPED_FIELDS,
    """SELECT CASE WHEN l_partkey % 50 = 1 THEN '' ELSE 'f' END AS field_key, 'quantity' AS field_name, CASE WHEN l_partkey % 50 > 5 THEN l_returnflag END AS raw_value,
CASE WHEN l_partkey % 50 BETWEEN 2 AND 6 THEN 'unresolved' ELSE 'observed' END AS status, CASE WHEN l_partkey % 50 < 5 THEN 'why' END AS diagnostic FROM lineitem""",
    {
        "text_blank": "field_key = ''",
        "missing_not_explained": "raw_value IS NULL AND (status = 'observed' OR diagnostic IS NULL)",
        "unresolved_with_value": "raw_value IS NOT NULL AND status = 'unresolved'",
    },
)
validation(
    "mapped_documents",
    rules.MAPPED_DOCUMENTS,
    "SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 30 = 1 THEN ' ' ELSE 'schema-v1' END AS mapping_schema FROM orders",
    {
        "schema_blank": BLANK.format("mapping_schema"),
        "field_keys_repeated": "fields_distinct < fields_count",
        "evidence_foreign": "evidence_strays > 0",
    },
    (Facts("fields", LINES), Facts("evidence", EVIDENCE, AVAILABLE)),
)
validation(
    "observations",
    rules.OBSERVATIONS,
    """SELECT 'o' AS observation_key, CASE WHEN l_partkey % 50 = 1 THEN ' ' ELSE 's' END AS subject_hint, 'p' AS predicate, CASE l_partkey % 50 WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'each' END AS unit,
CASE WHEN l_partkey % 50 <> 4 THEN CAST(l_shipdate AS TIMESTAMP) END AS effective_at, CASE WHEN l_partkey % 50 > 9 THEN l_quantity END AS value,
CASE WHEN l_partkey % 50 BETWEEN 5 AND 11 THEN 'unresolved' ELSE 'observed' END AS status, CASE WHEN l_partkey % 50 < 8 THEN 'why' END AS diagnostic,
CASE WHEN l_partkey % 50 > 12 THEN 'raw' END AS raw_value FROM lineitem""",
    {
        "text_blank": BLANK.format("subject_hint"),
        "unit_blank": "unit = ''",
        "instant_missing": NONE.format("effective_at"),
        "missing_not_explained": "value IS NULL AND (status = 'observed' OR diagnostic IS NULL)",
        "unresolved_with_value": "value IS NOT NULL AND status = 'unresolved'",
        "value_from_nothing": "raw_value IS NULL AND value IS NOT NULL",
    },
)
validation(
    "prediction_inputs",
    rules.PREDICTION_INPUTS,
    """SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 30 <> 1 THEN CAST(o_orderdate AS TIMESTAMP) END AS as_of, 'site-1' AS site_id FROM orders""",
    {
        "instant_missing": NONE.format("as_of"),
        "input_empty": "evidence_count = 0 AND states_count = 0",
        "evidence_repeated": "evidence_distinct < evidence_count",
        "states_repeated": "states_distinct < states_count",
        "scopes_differ": "foreign_states > 0",
        "future_state": "future_states > 0",
    },
    (
        Facts("evidence", EVIDENCE),
        Facts("states", LINES),
        Facts("foreign_states", DATED, offence="member_site <> site_id"),
        Facts("future_states", DATED, offence="member_time > as_of"),
    ),
)
validation(
    "predictions",
    rules.PREDICTIONS,
    f"""SELECT o_orderkey AS owner, 's' AS subject_key, CASE WHEN o_orderkey % 30 = 1 THEN '' ELSE 'o' END AS outcome, CASE WHEN o_orderkey % 30 <> 2 THEN 'v' END AS predicted_value,
CAST(CASE o_orderkey % 30 WHEN 3 THEN 1.5 WHEN 4 THEN -0.5 WHEN 5 THEN NULL ELSE 1 END AS DECIMAL(9,4)) AS confidence, CASE WHEN o_orderkey % 30 = 6 THEN ' ' ELSE 'basis' END AS uncertainty_basis,
CAST('2024-01-05 00:00:00' AS TIMESTAMP) AS as_of, CASE o_orderkey % 30 WHEN 7 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-06 00:00:00' AS TIMESTAMP) END AS horizon_start,
CASE o_orderkey % 30 WHEN 9 THEN NULL WHEN 10 THEN CAST('2024-01-05 12:00:00' AS TIMESTAMP) ELSE CAST('2024-01-07 00:00:00' AS TIMESTAMP) END AS horizon_end,
{_ORDER_SCOPE}, {_INPUT_SCOPE}, CASE o_orderkey % 30 WHEN 11 THEN CAST('2024-01-06 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-05 00:00:00' AS TIMESTAMP) END AS input_as_of,
CASE o_orderkey % 30 WHEN 12 THEN ' ' END AS unit FROM orders""",
    {
        "subject_blank": BLANK.format("outcome"),
        "value_missing": NONE.format("predicted_value"),
        "confidence_invalid": "confidence IS NULL OR confidence NOT BETWEEN 0 AND 1",
        "basis_blank": BLANK.format("uncertainty_basis"),
        "instant_missing": NONE.format("horizon_end"),
        "horizon_invalid": "owner % 30 IN (7, 10)",
        **members("evidence"),
        "scopes_differ": "input_project_id = 'x'",
        "before_input": "input_as_of > as_of",
        "evidence_foreign": "evidence_strays > 0",
        "unit_blank": "unit = ' '",
    },
    (Facts("evidence", EVIDENCE, AVAILABLE),),
)
validation(
    "decision_inputs",
    rules.DECISION_INPUTS,
    """SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 30 <> 1 THEN CAST(o_orderdate AS TIMESTAMP) END AS as_of, 'site-1' AS site_id FROM orders""",
    {
        "instant_missing": NONE.format("as_of"),
        "input_empty": "members_count = 0",
        "members_repeated": "members_distinct < members_count",
        "scopes_differ": "foreign_members > 0",
        "future_member": "future_members > 0",
    },
    (
        Facts("members", EVIDENCE),
        Facts("foreign_members", DATED, offence="member_site <> site_id"),
        Facts("future_members", DATED, offence="member_time > as_of"),
    ),
)
validation(
    "authorities",
    rules.AUTHORITIES,
    "SELECT 'a' AS authority_id, CASE WHEN c_custkey % 40 = 1 THEN ' ' ELSE 'p' END AS principal_id, CASE WHEN c_custkey % 40 = 2 THEN '' ELSE 'buyer' END AS role FROM customer",
    {"authority_blank": "trim(principal_id) = '' OR trim(role) = ''"},
)
validation(
    "decisions",
    rules.DECISIONS,
    f"""SELECT o_orderkey AS owner, 's' AS subject_key, CASE WHEN o_orderkey % 30 = 1 THEN ' ' ELSE 'why' END AS rationale, 'p' AS policy_id, {_ORDER_SCOPE}, {_INPUT_SCOPE},
CASE WHEN o_orderkey % 30 <> 2 THEN CAST('2024-01-05 00:00:00' AS TIMESTAMP) END AS decided_at,
CASE WHEN o_orderkey % 30 = 4 THEN CAST('2024-01-06 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-05 00:00:00' AS TIMESTAMP) END AS input_as_of FROM orders""",
    {
        "text_blank": BLANK.format("rationale"),
        "authority_scope_differs": "input_project_id = 'x'",
        "instant_missing": NONE.format("decided_at"),
        "before_input": "decided_at < input_as_of",
        **members("evidence"),
    },
    (Facts("evidence", EVIDENCE),),
)
validation(
    "approvals",
    rules.APPROVALS,
    f"""SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 30 = 1 THEN '' ELSE 'd' END AS decision_id, CASE o_orderkey % 30 WHEN 1 THEN '' WHEN 2 THEN 'e' ELSE 'd' END AS approved_decision_id,
o_orderkey % 30 <> 4 AS may_approve_actions, CASE WHEN o_orderkey % 30 <> 5 THEN CAST('2024-01-05 00:00:00' AS TIMESTAMP) END AS approved_at,
CASE WHEN o_orderkey % 30 = 6 THEN 'defer' ELSE 'recommend' END AS outcome, {_ORDER_SCOPE}, {_INPUT_SCOPE},
CASE WHEN o_orderkey % 30 = 7 THEN CAST('2024-01-06 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-05 00:00:00' AS TIMESTAMP) END AS decided_at FROM orders""",
    {
        "decision_blank": "decision_id = ''",
        "not_permitted": "NOT may_approve_actions",
        "instant_missing": NONE.format("approved_at"),
        **members("evidence"),
        "not_recommended": "outcome = 'defer'",
        "other_decision": "approved_decision_id = 'e'",
        "authority_scope_differs": "input_project_id = 'x'",
        "before_decision": "approved_at < decided_at",
    },
    (Facts("evidence", EVIDENCE),),
)
validation(
    "actions",
    rules.ACTIONS,
    """SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 40 = 1 THEN ' ' ELSE 'order' END AS action_kind, CASE WHEN o_orderkey % 40 = 2 THEN '' ELSE 'key' END AS idempotency_key,
CASE WHEN o_orderkey % 40 <> 3 THEN CAST('2024-01-05 00:00:00' AS TIMESTAMP) END AS attempted_at,
CASE WHEN o_orderkey % 40 = 4 THEN CAST('2024-01-06 00:00:00' AS TIMESTAMP) ELSE CAST('2024-01-04 00:00:00' AS TIMESTAMP) END AS approved_at,
CASE WHEN o_orderkey % 40 = 5 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) WHEN o_orderkey % 7 < 5 THEN CAST('2024-01-06 00:00:00' AS TIMESTAMP) END AS completed_at,
CASE o_orderkey % 40 WHEN 6 THEN ' ' WHEN 7 THEN 'ref' END AS external_reference,
CASE o_orderkey % 3 WHEN 0 THEN 'attempted' WHEN 1 THEN 'succeeded' ELSE 'failed' END AS status,
CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'reason' WHEN 2 THEN 'reason' END AS failure_reason FROM orders""",
    {
        "kind_blank": BLANK.format("action_kind"),
        "idempotency_blank": BLANK.format("idempotency_key"),
        "instant_missing": NONE.format("attempted_at"),
        "before_approval": "attempted_at < approved_at",
        "completed_before_attempt": "completed_at < attempted_at",
        **members("evidence"),
        "reference_blank": "external_reference = ' '",
        "attempt_with_outcome": "status = 'attempted' AND (completed_at IS NOT NULL OR failure_reason IS NOT NULL)",
        "completion_missing": "status IN ('succeeded', 'failed') AND completed_at IS NULL",
        "reason_missing": "status = 'failed' AND (failure_reason IS NULL OR failure_reason = '')",
        "reason_unexpected": "status <> 'failed' AND failure_reason IS NOT NULL",
    },
    (Facts("evidence", EVIDENCE),),
)
validation(
    "runs",
    rules.RUNS,
    "SELECT CASE WHEN s_suppkey % 15 = 1 THEN '' ELSE 'run' END AS run_id, CASE WHEN s_suppkey % 15 <> 2 THEN CAST('2024-01-05 00:00:00' AS TIMESTAMP) END AS started_at FROM supplier",
    {"run_missing": EMPTY.format("run_id"), "instant_missing": NONE.format("started_at")},
)
validation(
    "components",
    rules.COMPONENTS,
    """SELECT CASE WHEN c_custkey % 15 = 1 THEN '' ELSE 'c' END AS component_name, '1' AS implementation_version, CASE WHEN c_custkey % 2 = 0 THEN 'model' ELSE 'human' END AS component_kind,
'provider' AS model_provider, CASE WHEN c_custkey % 15 < 4 THEN 'm' END AS model_id, CASE WHEN c_custkey % 15 = 2 THEN '' ELSE 'r' END AS model_revision FROM customer""",
    {
        "component_missing": EMPTY.format("component_name"),
        "model_incomplete": "component_kind = 'model' AND (model_id IS NULL OR model_revision = '')",
    },
)
validation(
    "transformation_events",
    rules.TRANSFORMATION_EVENTS,
    "SELECT o_orderkey AS owner, CASE WHEN o_orderkey % 30 = 1 THEN '' ELSE 'structuring' END AS event_type FROM orders",
    {
        "event_type_missing": EMPTY.format("event_type"),
        "outputs_missing": "outputs_count = 0",
        "edge_target_missing": "empty_targets > 0",
    },
    (Facts("outputs", EVIDENCE), Facts("empty_targets", STATES, offence="trim(member) = ''")),
)
validation(
    "projection_requests",
    rules.PROJECTION_REQUESTS,
    """SELECT CASE WHEN event_id % 60 = 1 THEN '' ELSE 'p' END AS projection_id, '1' AS implementation_version, CASE WHEN event_id % 60 <> 2 THEN 'cfg' END AS config_digest,
CASE WHEN event_id % 60 <> 3 THEN observed_at END AS requested_at FROM {event_ledger}""",
    {
        "request_incomplete": "projection_id = '' OR config_digest IS NULL",
        "instant_missing": NONE.format("requested_at"),
    },
)
validation(
    "projection_manifests",
    rules.PROJECTION_MANIFESTS,
    """SELECT CASE WHEN event_id % 60 <> 1 THEN observed_at END AS source_as_of, observed_at AS recorded_at, CASE WHEN predicate = 'error' THEN 'failed' ELSE 'ready' END AS status,
CASE WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 2 THEN 'why' END AS failure_reason FROM {event_ledger}""",
    {
        "instant_missing": NONE.format("source_as_of"),
        "reason_missing": "status = 'failed' AND (failure_reason IS NULL OR failure_reason = '')",
        "reason_unexpected": "status = 'ready' AND failure_reason IS NOT NULL",
    },
)
validation(
    "retrieval_hits",
    rules.HITS,
    "SELECT CASE event_id % 30 WHEN 1 THEN 0.0 WHEN 2 THEN 1.25 WHEN 3 THEN NULL WHEN 4 THEN -0.5 ELSE 1.0 END AS score FROM {event_ledger}",
    {"score_out_of_range": "score IS NULL OR score <= 0 OR score > 1"},
)
validation(
    "request_contexts",
    rules.REQUEST_CONTEXTS,
    "SELECT 'u' AS principal_id, CASE WHEN event_id % 30 = 1 THEN '' ELSE 't' END AS tenant_id, 'p' AS project_id, CASE WHEN event_id % 30 <> 2 THEN 's' END AS site_id, CASE WHEN event_id % 30 = 3 THEN ' ' ELSE 'x' END AS trace_id FROM {event_ledger}",
    {"context_incomplete": "tenant_id = '' OR site_id IS NULL"},
)
validation(
    "scopes",
    rules.SCOPES,
    "SELECT tenant_id, CASE WHEN event_id % 30 = 1 THEN '' ELSE project_id END AS project_id, CASE WHEN event_id % 30 <> 2 THEN site_id END AS site_id, version FROM {event_ledger}",
    {"scope_incomplete": "project_id = '' OR site_id IS NULL"},
)
validation(
    "anomaly_policies",
    rules.POLICIES,
    """SELECT CASE WHEN c_custkey % 40 = 1 THEN ' ' ELSE 'policy' END AS policy_id, CAST(CASE c_custkey % 40 WHEN 2 THEN -1 WHEN 3 THEN NULL ELSE 5 END AS DECIMAL(18,6)) AS tolerance FROM customer""",
    {"policy_blank": BLANK.format("policy_id"), "tolerance_invalid": BAD.format("tolerance")},
)
validation(
    "detector_inputs",
    rules.DETECTOR_INPUTS,
    """SELECT CAST(CASE WHEN l_partkey % 60 = 1 THEN -1 ELSE 1 END AS DECIMAL(18,6)) AS expected_quantity, CASE WHEN l_partkey % 60 <> 2 THEN CAST(l_quantity AS DECIMAL(18,6)) END AS observed_quantity,
CASE WHEN l_partkey % 60 = 3 THEN ' ' ELSE l_linestatus END AS expected_revision, 'O' AS observed_revision, CASE WHEN l_partkey % 60 = 4 THEN '' ELSE 'm' END AS mention FROM lineitem""",
    {
        "quantity_invalid": "expected_quantity < 0 OR observed_quantity IS NULL",
        "revision_blank": BLANK.format("expected_revision"),
        "mention_blank": BLANK.format("mention"),
    },
)

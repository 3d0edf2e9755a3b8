"""Queries over expected and observed state, anomalies, purchasing and reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import normalize_identifier
from ledgerline.operators import anomalies, claims, evidence, governed, members, metrics, provenance, purchasing, resolution, state
from ledgerline.operators.anomalies import Policy, StatePolicies
from ledgerline.plans import bom_run, stage_trace, worklists
from ledgerline.registry.base import S, normalized, on_scope, query
from ledgerline.registry.bom import (
    BY,
    CAND,
    SCOPE_JSON,
    claimed,
    component_sql,
    cutoff,
    id_part,
    reconciled,
    resolved,
    resolved_lines,
    small_keys,
    sql_decimal,
    sql_id,
    sql_text,
)
from ledgerline.session import materialize
from ledgerline.sources.bindings import CUTOFF, KEYWORD, PRECEDENCE, bind, inline, run_sql, table

AT = f"TIMESTAMP '{CUTOFF}'"


def prefixed(alias: str) -> str:
    return ", ".join(f"{alias}.{c}" for c in S.split(", "))


# ---- as-of state ----------------------------------------------------------------------------

LATEST = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {S}, canonical_key
  ORDER BY as_of DESC, input_ordinal) AS place FROM {{observed}} WHERE as_of <= {AT}) WHERE place = 1)"""
PAIRS = f"""{LATEST}, pairs AS (SELECT {prefixed('e')}, e.canonical_key, e.required_quantity, e.as_of, o.input_ordinal AS observed_ordinal,
  o.as_of AS observed_as_of, o.ordered_quantity, o.received_quantity, o.substituted_quantity, o.delayed_quantity, o.unknown_quantity,
  CASE WHEN o.canonical_key IS NULL THEN 'unknown' ELSE o.freshness END AS freshness,
  CAST(CASE WHEN e.required_quantity - coalesce(o.received_quantity, 0) < 0 THEN 0
       ELSE e.required_quantity - coalesce(o.received_quantity, 0) END AS DECIMAL(38,6)) AS outstanding_quantity
  FROM {{expected}} e LEFT JOIN latest o ON {on_scope('e', 'o')} AND e.canonical_key = o.canonical_key WHERE e.as_of <= {AT})"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return state.compare_expected_observed(bind(spark, sf, "expected"), bind(spark, sf, "observed"), cutoff())


@query(
    "latest_observed",
    f"WITH {LATEST} SELECT {S}, canonical_key, as_of, input_ordinal, CAST(ordered_quantity AS DECIMAL(38,6)) AS ordered_quantity FROM latest",
)
def latest_observed(spark: SparkSession, sf: str) -> DataFrame:
    latest = state.latest_observed(bind(spark, sf, "observed"), cutoff())
    return latest.select(*BY, "canonical_key", "as_of", "input_ordinal", "ordered_quantity")


@query(
    "expected_vs_observed",
    f"""WITH {PAIRS} SELECT {S}, canonical_key, CAST(required_quantity AS DECIMAL(38,6)) AS required_quantity, observed_as_of,
CAST(ordered_quantity AS DECIMAL(38,6)) AS ordered_quantity, CAST(received_quantity AS DECIMAL(38,6)) AS received_quantity,
freshness, outstanding_quantity FROM pairs""",
)
def expected_vs_observed(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select(
        *BY,
        "canonical_key",
        "required_quantity",
        "observed_as_of",
        "ordered_quantity",
        "received_quantity",
        "freshness",
        "outstanding_quantity",
    )


@query(
    "outstanding",
    f"""WITH {PAIRS} SELECT {S}, count(*) AS subjects, CAST(sum(outstanding_quantity) AS DECIMAL(38,6)) AS outstanding_quantity,
count(*) FILTER (outstanding_quantity = 0) AS settled FROM pairs GROUP BY {S}""",
)
def outstanding(spark: SparkSession, sf: str) -> DataFrame:
    return (
        pairs(spark, sf)
        .groupBy(*BY)
        .agg(
            F.count(F.lit(1)).alias("subjects"),
            F.sum("outstanding_quantity").alias("outstanding_quantity"),
            F.count(F.when(F.col("outstanding_quantity") == 0, 1)).alias("settled"),
        )
    )


@query(
    "operational_state",
    f"""WITH {PAIRS} SELECT tenant_id || '/' || project_id || '/' || site_id || '/' || version || ':' || canonical_key AS subject_key,
freshness, 6 AS attribute_count, CAST((ordered_quantity IS NULL)::INT * 5 AS BIGINT) AS unresolved_count,
CAST(required_quantity AS DECIMAL(38,6)) AS first_value FROM pairs""",
)
def operational_state(spark: SparkSession, sf: str) -> DataFrame:
    rolled = state.operational_state(state.state_attributes(pairs(spark, sf)))
    return rolled.select(
        "subject_key",
        "freshness",
        F.size("attributes").alias("attribute_count"),
        "unresolved_count",
        F.col("attributes")[0]["value"].alias("first_value"),
    )


@query(
    "derived_facts",
    f"""WITH {PAIRS} SELECT tenant_id || '/' || project_id || '/' || site_id || '/' || version || ':' || canonical_key AS subject_key,
'outstanding_quantity' AS predicate, outstanding_quantity AS value, as_of, 'inferred' AS status FROM pairs""",
)
def derived_facts(spark: SparkSession, sf: str) -> DataFrame:
    return state.derived_facts(pairs(spark, sf)).select("subject_key", "predicate", "value", "as_of", "status")


# evidence of requirements (the lines behind them) and observations (the event)
EXPECTED_EVIDENCE = """req AS (SELECT 'tenant-1' AS tenant_id, 'project-'||(l_suppkey % 5) AS project_id, 'site-1' AS site_id, 'r1' AS version,
  'P-'||lpad(CAST(l_partkey AS VARCHAR),7,'0') AS canonical_key, CAST(l_orderkey AS BIGINT) * 100 + l_linenumber AS position,
  {id} AS evidence_id FROM lineitem)""".replace(
    "{id}",
    sql_id(
        "evidence",
        "'\"lineitem\"'",
        "'\"hash-lineitem\"'",
        "'\"record\"'",
        "'\"lineitem\"'",
        sql_text(
            "CAST(l_orderkey AS VARCHAR)||'-'||CAST(l_linenumber AS VARCHAR)||'-'||CAST(l_partkey AS VARCHAR)||'-'||CAST(l_suppkey AS VARCHAR)"
        ),
    ),
)
OBSERVED_EVIDENCE_ID = sql_id(
    "evidence",
    "'\"events\"'",
    "'\"hash-events\"'",
    "'\"record\"'",
    "'\"events\"'",
    sql_text("CAST(observed_ordinal AS VARCHAR)"),
)
STATE_EVIDENCE = f"""{PAIRS}, {EXPECTED_EVIDENCE},
allev AS (SELECT r.*, 0 AS side FROM req r JOIN pairs p ON {on_scope('r', 'p')} AND r.canonical_key = p.canonical_key
UNION ALL SELECT {S}, canonical_key, observed_ordinal, {OBSERVED_EVIDENCE_ID}, 1 FROM pairs WHERE observed_ordinal IS NOT NULL),
ev AS (SELECT {S}, canonical_key, evidence_id, min(side) AS side FROM allev GROUP BY ALL)"""


def evidence_of_pairs(spark: SparkSession, sf: str, matched: DataFrame) -> DataFrame:
    lines = bind(spark, sf, "bom_lines")
    key = F.concat(F.lit("P-"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"))
    project = F.concat(F.lit("project-"), (F.substring_index("project_id", "-", -1).cast("bigint") % 5).cast("string"))
    required = (
        lines.withColumn("project_id", project)
        .withColumn("canonical_key", key)
        .select(
            *BY,
            "canonical_key",
            F.col("line_no").alias("position"),
            evidence.record_evidence_id(
                F.lit("lineitem"), F.lit("hash-lineitem"), F.lit("lineitem"), F.col("record_key")
            ).alias("evidence_id"),
        )
        .join(matched.select(*BY, "canonical_key"), [*BY, "canonical_key"], "left_semi")
    )
    seen = matched.where("observed_ordinal is not null").select(
        *BY,
        "canonical_key",
        F.col("observed_ordinal").alias("position"),
        evidence.record_evidence_id(
            F.lit("events"), F.lit("hash-events"), F.lit("events"), F.col("observed_ordinal").cast("string")
        ).alias("evidence_id"),
    )
    return anomalies.state_evidence(required, seen)


@query(
    "state_evidence",
    f"WITH {STATE_EVIDENCE} SELECT {S}, canonical_key, evidence_id, side FROM ev",
)
def state_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return evidence_of_pairs(spark, sf, pairs(spark, sf)).select(*BY, "canonical_key", "evidence_id", "side")


# ---- anomalies over state -------------------------------------------------------------------

POLICIES = StatePolicies(
    missing_po=Policy("missing-po", Decimal(2)),
    quantity_mismatch=Policy("quantity-mismatch", Decimal(5)),
    substitution=Policy("substitution"),
    coverage_gap=Policy("coverage-gap", Decimal(1)),
)

RULES = {
    "missing_po": (
        "(observed_ordinal IS NULL OR ordered_quantity <= 0) AND required_quantity > 2",
        "required_quantity",
        "ordered_quantity",
        "warning",
        "missing-po",
    ),
    "quantity_mismatch": (
        "ordered_quantity > 0 AND abs(ordered_quantity - required_quantity) > 5",
        "required_quantity",
        "ordered_quantity",
        "warning",
        "quantity-mismatch",
    ),
    "substitution": ("substituted_quantity > 0", "0", "substituted_quantity", "warning", "substitution"),
    "coverage_gap": (
        "observed_ordinal IS NOT NULL AND (freshness <> 'current' OR unknown_quantity > 1)",
        "required_quantity",
        "unknown_quantity",
        "info",
        "coverage-gap",
    ),
}


def rule_sql(kind: str) -> str:
    condition, expected, observed, severity, policy = RULES[kind]
    return f"""SELECT {S}, canonical_key, tenant_id || '/' || project_id || '/' || site_id || '/' || version || ':' || canonical_key AS subject_key,
'{kind}' AS kind, CAST({expected} AS DECIMAL(38,6)) AS expected, CAST({observed} AS DECIMAL(38,6)) AS observed, '{severity}' AS severity,
'open' AS status, '{policy}' AS policy_id, {AT} AS detected_at FROM pairs WHERE {condition}"""


ALL_RULES = " UNION ALL ".join(rule_sql(kind) for kind in RULES)
SHOWN = ("subject_key", "kind", "expected", "observed", "severity", "status", "policy_id", "detected_at")


def found(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    return anomalies.state_anomalies(pairs(spark, sf), POLICIES, cutoff(), kinds=kinds or anomalies.STATE_KINDS)


def one_kind(kind: str) -> None:
    query(f"anomaly_{kind}", f"WITH {PAIRS} SELECT {', '.join(SHOWN)} FROM ({rule_sql(kind)})")(
        lambda spark, sf: found(spark, sf, kind).select(*SHOWN)
    )


for _kind in anomalies.STATE_KINDS:
    one_kind(_kind)


@query("state_anomalies", f"WITH {PAIRS} SELECT {', '.join(SHOWN)} FROM ({ALL_RULES})")
def state_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).select(*SHOWN)


@query(
    "anomaly_ids",
    f"""WITH {STATE_EVIDENCE},
lists AS (SELECT {S}, canonical_key, count(*) AS n, list(evidence_id ORDER BY evidence_id) AS ids
          FROM ev GROUP BY {S}, canonical_key),
an AS ({ALL_RULES})
SELECT a.subject_key, a.kind, {sql_id('anomaly', sql_text('a.subject_key'),
    SCOPE_JSON.replace('tenant_id ||', 'a.tenant_id ||').replace('project_id ||', 'a.project_id ||').replace('site_id ||', 'a.site_id ||').replace('|| site_id', '|| a.site_id').replace('|| version', '|| a.version'),
    sql_text('a.kind'),
    sql_text(sql_decimal('a.expected')), "coalesce(" + sql_text(sql_decimal('a.observed')) + ", '\"None\"')",
    id_part('ids'), sql_text('a.policy_id'),
    sql_text('(' + component_sql(('state-detector', 'deterministic', '1')) + ')'))} AS anomaly_id
FROM an a JOIN lists l ON {on_scope('a', 'l')} AND a.canonical_key = l.canonical_key""",
)
def anomaly_ids(spark: SparkSession, sf: str) -> DataFrame:
    matched = pairs(spark, sf)
    prov = provenance.component_provenance(
        provenance.run_id(provenance.local_run()), ("state-detector", "deterministic", "1")
    )
    raised = anomalies.state_anomalies(matched, POLICIES, cutoff())
    named = anomalies.anomaly_ids(raised, evidence_of_pairs(spark, sf, matched), prov)
    return named.select("subject_key", "kind", "anomaly_id")


DETECT = f"""{resolved('bom_lines')},
need AS (SELECT {S}, canonical_key, CAST(sum(quantity) AS DECIMAL(20,6)) AS required_quantity FROM res
  WHERE canonical_key IS NOT NULL GROUP BY {S}, canonical_key),
seen AS (SELECT tenant_id, 'project-' || (input_ordinal % 100) AS project_id, site_id, version, canonical_key, as_of, input_ordinal,
  ordered_quantity, substituted_quantity, unknown_quantity, freshness FROM {{observed}}),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {S}, canonical_key ORDER BY as_of DESC, input_ordinal) AS place
  FROM seen WHERE as_of <= {AT}) WHERE place = 1),
pairs AS (SELECT n.*, o.input_ordinal AS observed_ordinal, ordered_quantity, substituted_quantity, unknown_quantity, freshness
  FROM need n LEFT JOIN latest o ON {on_scope('n', 'o')} AND n.canonical_key = o.canonical_key)"""


@query(
    "detect_end_to_end",
    f"WITH {DETECT} SELECT {', '.join(SHOWN)} FROM ({ALL_RULES})",
)
def detect_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    required = state.expected_requirements(resolved_lines(spark, sf), cutoff())
    project = F.concat(F.lit("project-"), (F.col("input_ordinal") % 100).cast("string"))
    observed = bind(spark, sf, "observed").withColumn("project_id", project)
    compared = state.compare_expected_observed(required, observed, cutoff())
    return anomalies.state_anomalies(compared, POLICIES, cutoff()).select(*SHOWN)


# ---- stand-alone detectors ------------------------------------------------------------------


def alone(name: str, check: str, rows, detector, policy: Policy, keys: tuple[str, ...]) -> None:
    shown = [*keys, "kind", "expected", "observed", "severity", "status", "policy_id", "detected_at"]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return detector(rows(spark, sf), policy, cutoff()).select(*shown)

    query(name, check)(run)


def detected(keys: str, kind: str, expected: str, observed: str, policy: str, source: str, condition: str) -> str:
    return f"""SELECT {keys}, '{kind}' AS kind, {expected} AS expected, {observed} AS observed, 'warning' AS severity, 'open' AS status,
'{policy}' AS policy_id, {AT} AS detected_at FROM {source} WHERE {condition}"""


COVERAGE = f"""need AS (SELECT {S}, boq_id, line_id, CAST(quantity AS DECIMAL(38,6)) AS expected FROM {{boq_lines}}),
got AS (SELECT {S}, boq_id, boq_line_id AS line_id, sum(quantity) AS q, count(*) AS n FROM {{po_lines}} WHERE boq_id IS NOT NULL GROUP BY ALL),
cov AS (SELECT need.*, CAST(coalesce(q, 0) AS DECIMAL(38,6)) AS observed, coalesce(n, 0) AS po_lines FROM need
  LEFT JOIN got ON {on_scope('need', 'got')} AND need.boq_id = got.boq_id AND need.line_id = got.line_id)"""


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return purchasing.boq_coverage(bind(spark, sf, "boq_lines"), bind(spark, sf, "po_lines"))


alone(
    "anomaly_quantity_standalone",
    f"WITH {COVERAGE} "
    + detected("boq_id, line_id", "quantity_mismatch", "expected", "observed", "boq-quantity", "cov", "abs(observed - expected) > 4"),
    lambda spark, sf: coverage(spark, sf).select(
        "boq_id", "line_id", F.col("required_quantity").alias("expected"), F.col("ordered_quantity").alias("observed")
    ),
    anomalies.quantity_mismatch,
    Policy("boq-quantity", Decimal(4)),
    ("boq_id", "line_id"),
)

PRICES = """prices AS (SELECT line_id, CAST(p_retailprice AS DECIMAL(18,6)) AS expected, unit_price AS observed
FROM {po_lines} JOIN part ON l_partkey = p_partkey)"""


def priced(spark: SparkSession, sf: str) -> DataFrame:
    return bind_sql(
        spark,
        sf,
        "SELECT line_id, CAST(p_retailprice AS DECIMAL(18,6)) AS expected, unit_price AS observed "
        "FROM {po_lines} JOIN part ON l_partkey = p_partkey",
    )


def bind_sql(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return run_sql(spark, sf, inline(sql))


alone(
    "anomaly_price_deviation",
    f"WITH {PRICES} "
    + detected(
        "line_id", "price_deviation", "CAST(expected AS DECIMAL(38,6))", "CAST(observed AS DECIMAL(38,6))", "price", "prices", "abs(observed - expected) > 150"
    ),
    priced,
    anomalies.price_deviation,
    Policy("price", Decimal(150)),
    ("line_id",),
)

alone(
    "anomaly_late_commitment",
    detected(
        "line_id", "late_commitment", "CAST(order_date AS DATE)", "ship_date", "late", "{po_lines}", "ship_date > order_date + INTERVAL 30 DAY"
    ),
    lambda spark, sf: bind(spark, sf, "po_lines").select(
        "line_id", F.col("order_date").alias("expected"), F.col("ship_date").alias("observed")
    ),
    anomalies.late_commitment,
    Policy("late", 30),
    ("line_id",),
)


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "po_lines").select("line_id", "item_key", F.col("l_linestatus").alias("observed"))
    newest = lines.groupBy("item_key").agg(F.max("observed").alias("expected"))
    return lines.join(newest, "item_key").select("line_id", "expected", "observed")


alone(
    "anomaly_stale_revision",
    "WITH m AS (SELECT item_key, max(l_linestatus) AS newest FROM {po_lines} GROUP BY 1), r AS (SELECT line_id, newest AS expected, l_linestatus AS observed FROM {po_lines} JOIN m USING (item_key)) "
    + detected("line_id", "stale_revision", "expected", "observed", "revision", "r", "expected <> observed"),
    revisions,
    anomalies.stale_revision,
    Policy("revision"),
    ("line_id",),
)

alone(
    "anomaly_unresolved_identity",
    f"WITH {resolved('bom_lines')}, m AS (SELECT DISTINCT {S}, sku AS mention, rationale FROM res WHERE canonical_key IS NULL) "
    + detected(f"{S}, mention, rationale", "unresolved_identity", "CAST(NULL AS VARCHAR)", "mention", "identity", "m", "true"),
    lambda spark, sf: resolution.resolve_identifiers(bind(spark, sf, "bom_lines"), bind(spark, sf, "candidates")),
    anomalies.unresolved_identity,
    Policy("identity"),
    (*BY, "mention", "rationale"),
)


# ---- purchasing -----------------------------------------------------------------------------


@query(
    "po_line_totals",
    "SELECT line_id, CAST(CAST(quantity AS DECIMAL(19,6)) * unit_price AS DECIMAL(38,12)) AS total FROM {po_lines}",
)
def po_line_totals(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "po_lines").select("line_id", purchasing.line_total().alias("total"))


@query(
    "po_totals",
    f"SELECT {S}, order_number, CAST(sum(CAST(quantity AS DECIMAL(19,6)) * unit_price) AS DECIMAL(38,12)) AS total, count(*) AS line_count FROM {{po_lines}} GROUP BY {S}, order_number",
)
def po_totals(spark: SparkSession, sf: str) -> DataFrame:
    return purchasing.order_totals(bind(spark, sf, "po_lines"))


@query(
    "po_boq_coverage",
    f"""WITH {COVERAGE} SELECT {S}, boq_id, line_id, expected AS required_quantity, observed AS ordered_quantity,
CAST(CASE WHEN expected > observed THEN expected - observed ELSE 0 END AS DECIMAL(38,6)) AS uncovered_quantity, po_lines,
CASE WHEN po_lines = 0 THEN 'unordered' WHEN observed < expected THEN 'partial' ELSE 'covered' END AS coverage FROM cov""",
)
def po_boq_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage(spark, sf).drop("item_key")


@query(
    "po_references",
    f"""WITH o AS (SELECT {S}, boq_id, boq_line_id AS line_id, sum(quantity) AS q, count(*) AS n FROM {{po_lines}} GROUP BY ALL),
b AS (SELECT {S}, boq_id, line_id, sum(quantity) AS r FROM {{boq_lines}} GROUP BY ALL)
SELECT {", ".join(f"coalesce(b.{c}, o.{c}) AS {c}" for c in S.split(", "))}, coalesce(b.boq_id, o.boq_id) AS boq_id, coalesce(b.line_id, o.line_id) AS line_id,
CASE WHEN o.n IS NULL THEN 'unordered' WHEN b.r IS NOT NULL THEN 'linked'
  WHEN EXISTS (SELECT 1 FROM {{boq_lines}} x WHERE x.boq_id = o.boq_id AND x.line_id = o.line_id) THEN 'scope_mismatch' ELSE 'dangling' END AS linked,
CAST(r AS DECIMAL(38,6)) AS required_quantity, CAST(q AS DECIMAL(38,6)) AS ordered_quantity, coalesce(n, 0) AS po_lines
FROM b FULL JOIN (SELECT * FROM o WHERE boq_id IS NOT NULL) o ON {on_scope('b', 'o')} AND b.boq_id = o.boq_id AND b.line_id = o.line_id
UNION ALL SELECT {S}, NULL, NULL, 'unreferenced', NULL, CAST(sum(q) AS DECIMAL(38,6)), CAST(sum(n) AS BIGINT) FROM o WHERE boq_id IS NULL GROUP BY {S}""",
)
def po_references(spark: SparkSession, sf: str) -> DataFrame:
    return purchasing.order_references(bind(spark, sf, "boq_lines"), bind(spark, sf, "po_lines"))


PO_LINE_ID_SQL = sql_id(
    "purchase-order-line",
    sql_text("line_id"),
    sql_text("item_key"),
    sql_text(sql_decimal("quantity")),
    sql_text("unit"),
    sql_text(sql_decimal("unit_price")),
    sql_text("currency"),
    sql_text("strftime(order_date, '%Y-%m-%d')"),
    "'\"e-' || line_id || '\"'",
    "coalesce('\"' || boq_id || '\"', 'null')",
    "coalesce('\"' || boq_line_id || '\"', 'null')",
)


@query(
    "purchase_order_ids",
    f"""WITH ids AS (SELECT *, {PO_LINE_ID_SQL} AS lid FROM {{po_lines}}),
lists AS (SELECT {S}, order_number, list(lid ORDER BY l_linenumber, lid) AS ids FROM ids GROUP BY {S}, order_number)
SELECT l.order_number, {sql_id('purchase-order', sql_text('l.order_number'), sql_text('supplier_key'), sql_text('l.tenant_id'), sql_text('l.project_id'), sql_text('l.site_id'), sql_text('l.version'),
id_part('l.ids'), "'\"e-' || l.order_number || '\"'")} AS purchase_order_id
FROM lists l JOIN {{purchase_orders}} o ON l.order_number = o.order_number""",
)
def purchase_order_ids(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "po_lines").withColumn("required_by", F.col("order_date"))
    lines = lines.withColumn("evidence_id", F.concat(F.lit("e-"), F.col("line_id")))
    identified = lines.withColumn("po_line_id", purchasing.purchase_order_line_id())
    lists = members.id_lists(identified, ["order_number"], ["l_linenumber"], "po_line_id")
    orders = bind(spark, sf, "purchase_orders").withColumn(
        "evidence_id", F.concat(F.lit("e-"), F.col("order_number"))
    )
    return orders.join(lists, "order_number").select(
        "order_number", purchasing.purchase_order_id(F.col("entries")).alias("purchase_order_id")
    )


# ---- reports --------------------------------------------------------------------------------


@query(
    "requirement_breakdown",
    f"""WITH {PAIRS} SELECT {S}, canonical_key, CAST(required_quantity AS DECIMAL(38,6)) AS required_quantity,
CAST(coalesce(ordered_quantity, 0) AS DECIMAL(38,6)) AS ordered_quantity, CAST(coalesce(received_quantity, 0) AS DECIMAL(38,6)) AS received_quantity,
CAST(coalesce(substituted_quantity, 0) AS DECIMAL(38,6)) AS substituted_quantity, outstanding_quantity, freshness FROM pairs""",
)
def requirement_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return state.requirement_breakdown(pairs(spark, sf))


@query(
    "sku_worklist",
    f"""WITH {reconciled('bom_lines')},
spell AS (SELECT {S}, canonical_key, count(DISTINCT sku) AS mentions FROM res WHERE canonical_key IS NOT NULL GROUP BY {S}, canonical_key)
SELECT {prefixed('r')}, 'item' AS section, r.canonical_key AS item, CAST(quantity AS DECIMAL(38,6)) AS required_quantity, mentions, status AS note
FROM rec r JOIN spell s ON {on_scope('r', 's')} AND r.canonical_key = s.canonical_key
UNION ALL SELECT {S}, 'review', sku, CAST(sum(quantity) AS DECIMAL(38,6)), 1, rationale FROM res WHERE canonical_key IS NULL GROUP BY {S}, sku, rationale""",
)
def sku_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return worklists.sku_worklist(bind(spark, sf, "bom_lines"), bind(spark, sf, "candidates"), PRECEDENCE)


@query(
    "item_aliases",
    f"""WITH {resolved('bom_lines')} SELECT {S}, canonical_key, sku AS alias, count(*) AS line_count FROM res
WHERE canonical_key IS NOT NULL GROUP BY {S}, canonical_key, sku""",
)
def item_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return worklists.aliases(bind(spark, sf, "bom_lines"), bind(spark, sf, "candidates"))


# price assertions: ordered price per item at order date; some items never get one
PRICE_LIST = """SELECT item_key AS canonical_key, unit_price, CAST(order_date AS TIMESTAMP) AS effective_at FROM {po_lines} WHERE l_partkey % 23 <> 0"""
SCENARIO_CUTOFF = "1998-01-01 00:00:00"
SCENARIO = f"""{claimed('small_boms')},
pl AS ({PRICE_LIST}),
cur AS (SELECT canonical_key, unit_price FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY effective_at DESC, unit_price) AS place
  FROM pl WHERE effective_at <= TIMESTAMP '{SCENARIO_CUTOFF}') WHERE place = 1),
spelled AS (SELECT {S}, sku, canonical_key, CAST(sum(quantity) AS DECIMAL(20,6)) AS quantity FROM res GROUP BY {S}, sku, canonical_key),
sl AS (SELECT {prefixed('p')}, p.sku, p.canonical_key, p.quantity, c.unit_price,
  CASE WHEN p.canonical_key IS NULL THEN 'unresolved' WHEN c.unit_price IS NULL THEN 'missing_price' ELSE 'priced' END AS section,
  CAST(p.quantity * CAST(c.unit_price AS DECIMAL(17,6)) AS DECIMAL(38,12)) AS extension
  FROM spelled p LEFT JOIN cur c ON p.canonical_key = c.canonical_key)"""


def scenario(spark: SparkSession, sf: str) -> DataFrame:
    at = F.lit(SCENARIO_CUTOFF).cast("timestamp")
    return worklists.scenario_lines(
        bind(spark, sf, "small_boms"), bind(spark, sf, "candidates"), bind_sql(spark, sf, PRICE_LIST), at
    )


@query("scenario_lines", f"WITH {SCENARIO} SELECT {S}, sku, canonical_key, section, extension FROM sl")
def scenario_lines(spark: SparkSession, sf: str) -> DataFrame:
    return scenario(spark, sf).select(*BY, "sku", "canonical_key", "section", "extension")


@query(
    "scenario_cost",
    f"""WITH {SCENARIO}, t AS (SELECT {S}, count(*) FILTER (section = 'priced') AS priced_lines, count(*) FILTER (section = 'missing_price') AS missing_price_lines,
count(*) FILTER (section = 'unresolved') AS unresolved_lines, CAST(sum(extension) AS DECIMAL(38,12)) AS priced_subtotal FROM sl GROUP BY {S}),
u AS (SELECT *, CASE WHEN missing_price_lines + unresolved_lines = 0 THEN priced_subtotal END AS total FROM t)
SELECT {prefixed('u')}, priced_lines, missing_price_lines, unresolved_lines, priced_subtotal, total,
CASE WHEN missing_price_lines + unresolved_lines = 0 THEN 'inferred' ELSE 'unresolved' END AS status, c.value AS current_cost,
CAST(total - c.value AS DECIMAL(38,12)) AS difference FROM u LEFT JOIN claims c ON {on_scope('u', 'c')} AND c.kind = 'bom_cost'""",
)
def scenario_cost(spark: SparkSession, sf: str) -> DataFrame:
    made = claims.claims_from_summary(claims.scope_summary(small_keys(spark, sf, share=True)))
    current = made.where(F.col("kind") == claims.BOM_COST).select(*BY, F.col("value").alias("cost"))
    return worklists.scenario_cost(scenario(spark, sf), materialize(current, "scenario"))



@query(
    "commitment_delays",
    """WITH c AS (SELECT line_id AS commitment_id, CAST(order_date + INTERVAL 30 DAY AS DATE) AS promised_date FROM {po_lines}),
e AS (SELECT line_id AS commitment_id, ship_date AS observed_date FROM {po_lines} WHERE l_partkey % 7 <> 0),
m AS (SELECT commitment_id, max(observed_date) AS observed_date, count(*) AS event_count FROM e GROUP BY 1)
SELECT c.commitment_id, promised_date, observed_date, coalesce(event_count, 0) AS event_count,
date_diff('day', promised_date, observed_date) AS days_late,
CASE WHEN observed_date IS NULL THEN 'open' WHEN observed_date > promised_date + INTERVAL 7 DAY THEN 'late' ELSE 'on_time' END AS delay_status
FROM c LEFT JOIN m ON c.commitment_id = m.commitment_id""",
)
def commitment_delays(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "po_lines")
    promised = lines.select(F.col("line_id").alias("commitment_id"), F.date_add("order_date", 30).alias("promised_date"))
    seen = lines.where("l_partkey % 7 <> 0").select(
        F.col("line_id").alias("commitment_id"), F.col("ship_date").alias("observed_date")
    )
    return worklists.commitment_delays(promised, seen, 7)


@query(
    "alias_candidates",
    """SELECT DISTINCT 'itm-' || p_partkey AS canonical_key, unnest([ 'itm-' || p_partkey, p_name, p_name || ' ' || p_brand,
  CASE WHEN p_partkey % 5 <> 0 THEN p_brand || '/' || p_partkey ELSE p_name END ]) AS candidate FROM part""",
)
def alias_candidates(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    other = F.when(F.col("p_partkey") % 5 != 0, F.concat("p_brand", F.lit("/"), key)).otherwise(F.col("p_name"))
    items = table(spark, sf, "part").select(
        F.concat(F.lit("itm-"), key).alias("item_id"),
        F.col("p_name").alias("description"),
        F.array(F.concat_ws(" ", "p_name", "p_brand"), other).alias("aliases"),
    )
    return worklists.alias_candidates(items, "item_id", ["description"])


# ---- bundles and trace ----------------------------------------------------------------------


@query(
    "decision_inputs",
    f"""WITH {PAIRS}, an AS ({ALL_RULES}),
items AS (SELECT DISTINCT {S}, 'fact:' || canonical_key AS item_id FROM pairs UNION ALL SELECT DISTINCT {S}, kind || ':' || canonical_key FROM an)
SELECT {S}, {AT} AS bundle_as_of, count(*) AS members, min(item_id) AS first_member FROM items GROUP BY {S}""",
)
def decision_inputs(spark: SparkSession, sf: str) -> DataFrame:
    matched = pairs(spark, sf)
    facts = matched.select(*BY, F.concat(F.lit("fact:"), "canonical_key").alias("item_id"), "as_of")
    raised = anomalies.state_anomalies(matched, POLICIES, cutoff())
    alerts = raised.select(
        *BY, F.concat_ws(":", "kind", "canonical_key").alias("item_id"), F.col("detected_at").alias("as_of")
    )
    bundle = state.input_bundles(facts.unionByName(alerts), cutoff())
    return bundle.groupBy(*BY, "bundle_as_of").agg(
        F.count(F.lit(1)).alias("members"), F.min("item_id").alias("first_member")
    )


@query(
    "prediction_inputs",
    f"""WITH o AS (SELECT {S}, input_ordinal, as_of FROM {{observed}} WHERE as_of <= {AT})
SELECT {S}, {AT} AS bundle_as_of, count(*) AS members, max(as_of) AS newest FROM o GROUP BY {S}""",
)
def prediction_inputs(spark: SparkSession, sf: str) -> DataFrame:
    observed = bind(spark, sf, "observed").withColumn("item_id", F.col("input_ordinal").cast("string"))
    bundle = state.input_bundles(observed, cutoff())
    times = observed.select("item_id", "as_of")
    return bundle.join(times, "item_id").groupBy(*BY, "bundle_as_of").agg(
        F.count(F.lit(1)).alias("members"), F.max("as_of").alias("newest")
    )


# ---- states, facts and bundles with identifiers ---------------------------------------------

UNIT = "each"
SUBJECT_SQL = "tenant_id || '/' || project_id || '/' || site_id || '/' || version || ':' || canonical_key"


def instant_sql(value: str) -> str:
    return f"strftime({value}, '\"%Y-%m-%dT%H:%M:%S+00:00\"')"


def attribute_sql(name: str) -> str:
    shown = f"coalesce({sql_text(sql_decimal(name))}, 'null')"
    return f"""'["{name}",' || {shown} || ',"' || CASE WHEN {name} IS NULL THEN 'unresolved' ELSE 'observed' END || '"]'"""


def made_by(component: tuple[str, str, str]) -> Column:
    return provenance.component_provenance(provenance.run_id(provenance.local_run()), component)


STATES_SQL = f"""{STATE_EVIDENCE},
held AS (SELECT {S}, canonical_key, list(evidence_id ORDER BY side, evidence_id) AS ids FROM ev GROUP BY {S}, canonical_key),
stated AS (SELECT *, {SUBJECT_SQL} AS subject_key FROM pairs JOIN held USING ({S}, canonical_key)),
states AS (SELECT *, {sql_id('operational-state', sql_text('subject_key'), SCOPE_JSON, instant_sql('as_of'), sql_text('freshness'),
    "'[' || " + " || ',' || ".join(attribute_sql(name) for name in state.STATE_ATTRIBUTES) + " || ']'",
    id_part('ids'), sql_text('(' + component_sql(provenance.STATE_BUILDER) + ')'), "'null'")} AS state_id FROM stated),
facts AS (SELECT *, {sql_id('derived-fact', sql_text('subject_key'), "'\"outstanding_quantity\"'", sql_text(sql_decimal('outstanding_quantity')),
    SCOPE_JSON, instant_sql('as_of'), id_part('ids'), "'[\"' || state_id || '\"]'",
    sql_text('(' + component_sql(provenance.DERIVER) + ')'), f"'\"{UNIT}\"'")} AS fact_id FROM states)"""


def attributes_of(matched: DataFrame) -> DataFrame:
    return state.state_attributes(matched, unit=UNIT)


def shared_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Pairs and their evidence, written once for all that is made from them."""
    matched = materialize(pairs(spark, sf), "pairs")
    return matched, materialize(evidence_of_pairs(spark, sf, matched), "evidence")


def identified(
    spark: SparkSession, sf: str, matched: DataFrame | None = None, backing: DataFrame | None = None
) -> DataFrame:
    matched = pairs(spark, sf) if matched is None else matched
    backing = evidence_of_pairs(spark, sf, matched) if backing is None else backing
    return governed.identified_states(attributes_of(matched), backing, made_by(provenance.STATE_BUILDER))


@query(
    "state_attribute_evidence",
    f"""WITH {STATE_EVIDENCE}, n AS (SELECT {S}, canonical_key, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS o FROM ev GROUP BY ALL)
"""
    + " UNION ALL ".join(
        f"""SELECT {S}, canonical_key, '{name}' AS name, CAST({name} AS DECIMAL(38,6)) AS value, '{UNIT}' AS unit,
CASE WHEN {name} IS NULL THEN 'unresolved' ELSE 'observed' END AS status,
{"r" if name == "required_quantity" else "CASE WHEN o > 0 THEN o ELSE r END"} AS evidence_count FROM pairs JOIN n USING ({S}, canonical_key)"""
        for name in state.STATE_ATTRIBUTES
    ),
)
def state_attribute_evidence(spark: SparkSession, sf: str) -> DataFrame:
    matched = pairs(spark, sf)
    return governed.attribute_evidence(attributes_of(matched), evidence_of_pairs(spark, sf, matched))


@query(
    "operational_state_ids",
    f"WITH {STATES_SQL} SELECT subject_key, freshness, as_of, len(ids) AS evidence_count, state_id FROM states",
)
def operational_state_ids(spark: SparkSession, sf: str) -> DataFrame:
    return identified(spark, sf).select("subject_key", "freshness", "as_of", "evidence_count", "state_id")


@query(
    "derived_fact_ids",
    f"""WITH {STATES_SQL} SELECT subject_key, outstanding_quantity AS value, '{UNIT}' AS unit, as_of, state_id, len(ids) AS evidence_count, fact_id FROM facts""",
)
def derived_fact_ids(spark: SparkSession, sf: str) -> DataFrame:
    facts = governed.outstanding_facts(identified(spark, sf), made_by(provenance.DERIVER), UNIT)
    return facts.select("subject_key", "value", "unit", "as_of", "state_id", "evidence_count", "fact_id")


@query(
    "decision_input_ids",
    f"""WITH {STATES_SQL}, an AS ({ALL_RULES}),
sorted AS (SELECT {S}, canonical_key, list(evidence_id ORDER BY evidence_id) AS ids FROM ev GROUP BY {S}, canonical_key),
raised AS (SELECT {S}, {sql_id('anomaly', sql_text('subject_key'), SCOPE_JSON, sql_text('kind'), sql_text(sql_decimal('expected')),
    "coalesce(" + sql_text(sql_decimal('observed')) + ", '\"None\"')", id_part('ids'), sql_text('policy_id'),
    sql_text('(' + component_sql(('state-detector', 'deterministic', '1')) + ')'))} AS anomaly_id FROM an JOIN sorted USING ({S}, canonical_key)),
f AS (SELECT {S}, list(fact_id ORDER BY fact_id) AS fids FROM facts GROUP BY {S}),
a AS (SELECT {S}, list(anomaly_id ORDER BY anomaly_id) AS aids FROM raised GROUP BY {S})
SELECT {S}, {AT} AS as_of, len(fids) AS facts_count, coalesce(len(aids), 0) AS anomalies_count, 0::BIGINT AS predictions_count,
{sql_id('decision-input', SCOPE_JSON, instant_sql(AT), id_part('fids'), f"coalesce({id_part('aids')}, '[]')", "'[]'")} AS input_id
FROM f LEFT JOIN a USING ({S})""",
)
def decision_input_ids(spark: SparkSession, sf: str) -> DataFrame:
    matched, backing = shared_pairs(spark, sf)
    facts = governed.outstanding_facts(identified(spark, sf, matched, backing), made_by(provenance.DERIVER), UNIT)
    raised = anomalies.state_anomalies(matched, POLICIES, cutoff())
    named = anomalies.anomaly_ids(raised, backing, made_by(("state-detector", "deterministic", "1")))
    items = facts.select(*BY, F.lit("facts").alias("list"), F.col("fact_id").alias("item_id"), "as_of").unionByName(
        named.select(*BY, F.lit("anomalies").alias("list"), F.col("anomaly_id").alias("item_id"), F.col("detected_at").alias("as_of"))
    )
    return governed.identified_bundles(items, "decision-input", cutoff())


@query(
    "prediction_input_ids",
    f"""WITH {STATES_SQL},
e AS (SELECT {S}, list(DISTINCT evidence_id ORDER BY evidence_id) AS eids FROM ev GROUP BY {S}),
s AS (SELECT {S}, list(state_id ORDER BY state_id) AS sids FROM states GROUP BY {S})
SELECT {S}, {AT} AS as_of, len(eids) AS evidence_count, len(sids) AS states_count,
{sql_id('prediction-input', SCOPE_JSON, instant_sql(AT), id_part('eids'), id_part('sids'))} AS input_id FROM e JOIN s USING ({S})""",
)
def prediction_input_ids(spark: SparkSession, sf: str) -> DataFrame:
    matched, backing = shared_pairs(spark, sf)
    cited = backing.withColumn("as_of", cutoff())
    items = cited.select(*BY, F.lit("evidence").alias("list"), F.col("evidence_id").alias("item_id"), "as_of").unionByName(
        identified(spark, sf, matched, backing).select(*BY, F.lit("states").alias("list"), F.col("state_id").alias("item_id"), "as_of")
    )
    return governed.identified_bundles(items, "prediction-input", cutoff())


STAGES_SQL = "(VALUES " + ", ".join(f"({i}, '{s}', '{e}')" for i, (s, e) in enumerate(stage_trace.STAGES)) + ") t(stage_index, stage, empty_result)"


@query(
    "stage_trace",
    f"""WITH {reconciled('small_boms')},
sc AS (SELECT DISTINCT {S} FROM res),
counts AS (SELECT {S}, 'INGEST' AS stage, count(DISTINCT artifact_id) AS n FROM res GROUP BY {S}
UNION ALL SELECT {S}, 'ASSERT', sum(CASE WHEN unit_price IS NULL THEN 3 ELSE 4 END) FROM res GROUP BY {S}
UNION ALL SELECT {S}, 'RESOLVE', count(DISTINCT sku) FROM res GROUP BY {S}
UNION ALL SELECT {S}, 'RECONCILE', count(*) FROM rec GROUP BY {S})
SELECT {prefixed('sc')}, stage_index, t.stage, CAST(coalesce(n, 0) AS BIGINT) AS row_count,
CASE WHEN n > 0 THEN 'executed' ELSE empty_result END AS result
FROM sc CROSS JOIN {STAGES_SQL} LEFT JOIN counts c ON {on_scope('sc', 'c')} AND c.stage = t.stage""",
)
def trace(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "small_boms")
    done = bom_run.run_bom(lines, bind(spark, sf, "candidates"), PRECEDENCE, keyword=KEYWORD, share=True)
    return stage_trace.stage_trace(
        lines,
        {
            "INGEST": lines.select(*BY, "artifact_id").distinct(),
            "ASSERT": done.assertions,
            "RESOLVE": done.decisions,
            "RECONCILE": done.reconciled_lines,
        },
    )


# ---- quality metrics ------------------------------------------------------------------------


@query(
    "resolution_metrics",
    f"""WITH {CAND}, m AS (SELECT DISTINCT p_type, p_partkey, {normalized('sku')} AS mention,
CASE WHEN p_partkey % 29 = 0 THEN 'X-' || p_partkey WHEN p_partkey % 31 <> 0 THEN 'P-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS gold_key
FROM {{bom_lines}} JOIN part ON l_partkey = p_partkey),
d AS (SELECT m.*, CASE WHEN n = 1 THEN c END AS canonical_key, n FROM m LEFT JOIN cand ON mention = k),
t AS (SELECT p_type AS entity_type, count(*) AS mentions, count(canonical_key) AS resolved, count(*) FILTER (canonical_key = gold_key) AS correct,
count(*) FILTER (canonical_key IS NOT NULL AND canonical_key IS DISTINCT FROM gold_key) AS false_merges,
count(*) FILTER (n > 1) AS review, count(gold_key) AS gold FROM d GROUP BY 1)
SELECT *, correct::DOUBLE / resolved AS precision, correct::DOUBLE / gold AS recall, false_merges::DOUBLE / resolved AS false_merge_rate FROM t""",
)
def resolution_metrics(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "bom_lines")
    keyed = lines.select(normalize_identifier(F.col("sku")).alias("mention"), "l_partkey").distinct()
    number = F.col("p_partkey")
    gold_key = F.when(number % 29 == 0, F.concat(F.lit("X-"), number.cast("string"))).when(
        number % 31 != 0, F.concat(F.lit("P-"), F.lpad(number.cast("string"), 7, "0"))
    )
    part = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("entity_type"), gold_key.alias("gold_key"))
    decisions = resolution.resolve_rows(keyed, bind(spark, sf, "candidates"), mention="mention")
    gold = part.withColumnRenamed("p_partkey", "l_partkey")
    return metrics.resolution_metrics(decisions, gold, ["entity_type"], ["l_partkey"])


@query(
    "anomaly_precision_at_budget",
    f"""WITH {PAIRS}, an AS ({ALL_RULES}),
top AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(expected - coalesce(observed, 0)) DESC, subject_key) AS place FROM an),
lab AS (SELECT subject_key, kind, CAST(substr(canonical_key, 3) AS INT) % 3 <> 0 AS is_true FROM an WHERE canonical_key NOT LIKE '%5')
SELECT t.kind, count(*) AS alerts, count(*) FILTER (is_true) AS true_alerts, (count(*) FILTER (is_true))::DOUBLE / count(*) AS precision
FROM top t LEFT JOIN lab l ON t.subject_key = l.subject_key AND t.kind = l.kind WHERE place <= 50 GROUP BY t.kind""",
)
def anomaly_precision_at_budget(spark: SparkSession, sf: str) -> DataFrame:
    raised = found(spark, sf)
    labels = raised.where(~F.col("canonical_key").endswith("5")).select(
        "subject_key", "kind", (F.substring("canonical_key", 3, 9).cast("int") % 3 != 0).alias("is_true")
    )
    size: Column = F.abs(F.col("expected") - F.coalesce("observed", F.lit(0)))
    return metrics.precision_at_budget(
        raised, labels, 50, ["kind"], [size.desc(), F.asc("subject_key")], ["subject_key", "kind"]
    )

"""Queries over bill-of-materials lines: assertions, resolution, reconciliation, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import normalize_identifier
from ledgerline.functions.text import normalize_question
from ledgerline.operators import bom, claims, evidence, members, provenance, reconciliation, resolution, state
from ledgerline.operators.record_ids import with_record_id
from ledgerline.operators.scope import RequestContext, within
from ledgerline.plans import bom_run, claim_register
from ledgerline.registry.base import S, normalized, on_scope, query
from ledgerline.schemas import SCOPE
from ledgerline.session import materialize
from ledgerline.sources.bindings import CUTOFF, KEYWORD, PRECEDENCE, bind, table

BY = list(SCOPE)


def cutoff():
    return F.lit(CUTOFF).cast("timestamp")


# ---- SQL building blocks of the checks ------------------------------------------------------

CAND = f"cand AS (SELECT {normalized('candidate')} AS k, count(*) AS n, min(candidate) AS c FROM {{candidates}} GROUP BY 1)"


def resolved(source: str) -> str:
    return f"""{CAND}, res AS (
SELECT b.*, CASE WHEN n = 1 THEN c END AS canonical_key,
       CASE WHEN n = 1 THEN 'resolved' ELSE 'unresolved' END AS resolution,
       CASE WHEN n = 1 THEN 'normalized exact identifier match' WHEN n > 1 THEN 'ambiguous normalized candidate match'
            ELSE 'no normalized candidate match' END AS rationale
FROM {{{source}}} b LEFT JOIN cand ON {normalized('b.sku')} = k)"""


def reconciled(source: str) -> str:
    return f"""{resolved(source)}, src AS (
SELECT {S}, canonical_key, artifact_id, CAST(sum(quantity) AS DECIMAL(20,6)) AS q, count(*) AS n,
       count(DISTINCT coalesce(CAST(unit_price AS VARCHAR), 'none')) AS np,
       CASE WHEN count(DISTINCT coalesce(CAST(unit_price AS VARCHAR), 'none')) = 1 THEN min(unit_price) END AS p,
       CASE artifact_id WHEN 'bom-a.xlsx' THEN 1 WHEN 'bom-n.xlsx' THEN 2 ELSE 3 END AS rank
FROM res WHERE canonical_key IS NOT NULL GROUP BY {S}, canonical_key, artifact_id),
gov AS (SELECT *, row_number() OVER (PARTITION BY {S}, canonical_key ORDER BY rank) AS place,
       count(*) OVER (PARTITION BY {S}, canonical_key) AS sources,
       sum(n) OVER (PARTITION BY {S}, canonical_key) AS total FROM src),
rec AS (SELECT {", ".join("g." + c for c in S.split(", "))}, g.canonical_key, g.q AS quantity, g.p AS unit_price,
       g.artifact_id AS governing_source_artifact, g.sources AS source_count, g.n AS evidence_count,
       CAST(g.total - g.n AS BIGINT) AS losing_evidence_count,
       CASE WHEN g.np <> 1 OR EXISTS (SELECT 1 FROM src l WHERE {on_scope('l', 'g')}
              AND l.canonical_key = g.canonical_key AND l.artifact_id <> g.artifact_id
              AND (l.q <> g.q OR l.p IS DISTINCT FROM g.p)) THEN 'conflict' ELSE 'reconciled' END AS status
FROM gov g WHERE g.place = 1)"""


def claimed(source: str) -> str:
    """Claims by definition: per claim kind, its own lines, their keys and their reconciled rows."""
    return f"""{reconciled(source)},
kinds AS (SELECT * FROM (VALUES ('distinct_skus', 0), ('gpu_quantity', 1), ('bom_cost', 0)) t(kind, needs_keyword)),
sub AS (SELECT kind, r.* FROM res r JOIN kinds ON needs_keyword = 0 OR contains(lower(description), '{KEYWORD}')),
scopes AS (SELECT DISTINCT {S} FROM res),
facts AS (SELECT {S}, kind, count(*) AS evidence_count, count(*) FILTER (canonical_key IS NULL) AS unresolved
          FROM sub GROUP BY {S}, kind),
keyed AS (SELECT DISTINCT {S}, kind, canonical_key FROM sub WHERE canonical_key IS NOT NULL),
sums AS (SELECT {", ".join("k." + c for c in S.split(", "))}, kind, count(*) AS keys,
         count(*) FILTER (status = 'conflict') AS conflicts, count(*) FILTER (unit_price IS NULL) AS unpriced,
         sum(quantity) AS quantity,
         sum(CAST(quantity AS DECIMAL(20,6)) * CAST(unit_price AS DECIMAL(17,6))) AS cost
         FROM keyed k JOIN rec r ON {on_scope('k', 'r')} AND k.canonical_key = r.canonical_key
         GROUP BY ALL),
base AS (SELECT s.*, d.kind, coalesce(evidence_count, 0) AS evidence_count, coalesce(unresolved, 0) AS unresolved,
         coalesce(keys, 0) AS keys, conflicts, unpriced, quantity, cost,
         CASE WHEN coalesce(unresolved, 0) > 0 OR coalesce(evidence_count, 0) = 0 OR coalesce(keys, 0) = 0 THEN 'unresolved'
              WHEN conflicts > 0 THEN 'conflict' ELSE 'reconciled' END AS raw_status
         FROM scopes s CROSS JOIN kinds d
         LEFT JOIN facts f ON {on_scope('f', 's')} AND f.kind = d.kind
         LEFT JOIN sums m ON {on_scope('m', 's')} AND m.kind = d.kind),
stat AS (SELECT *, CASE WHEN kind = 'bom_cost' AND raw_status = 'reconciled' AND unpriced > 0 THEN 'unresolved'
                 ELSE raw_status END AS status FROM base),
claims AS (SELECT {S}, kind, status,
       CAST(CASE WHEN status <> 'reconciled' THEN NULL WHEN kind = 'gpu_quantity' THEN quantity
                 WHEN kind = 'bom_cost' THEN cost END AS DECIMAL(38,12)) AS value,
       CASE WHEN status = 'reconciled' AND kind = 'distinct_skus' THEN keys END AS key_count,
       evidence_count,
       CASE WHEN evidence_count > 0 AND unresolved = 0 THEN 'resolved' ELSE 'partially_resolved' END AS resolution_status,
       CASE WHEN keys > 0 THEN 'observed' ELSE 'unresolved' END AS state_status,
       CASE WHEN keys > 0 THEN status ELSE 'unresolved' END AS reconciliation_status
FROM stat)"""


def sql_entries(ids: str) -> str:
    """Entries that stand for an ordered list in SQL: its members, or the identifiers of its runs (enough for a million members)."""
    width = members.FANOUT
    runs = f"range(0, CAST(ceil(len({ids}) / {width}.0) AS BIGINT))"
    run = sql_id("block", sql_list(f"{ids}[r * {width} + 1 : (r + 1) * {width}]"))
    return f"CASE len({runs}) WHEN 1 THEN {ids} ELSE list_transform({runs}, lambda r: {run}) END"


def sql_list(values: str) -> str:
    """JSON array of plain identifiers in SQL."""
    return f"""('["' || array_to_string({values}, '","') || '"]')"""


def id_part(ids: str) -> str:
    return sql_list(sql_entries(ids))


def sql_id(namespace: str, *fragments: str) -> str:
    """Stable id in SQL; fragments are SQL expressions giving JSON text."""
    payload = " || ',' || ".join([f"'[\"{namespace}\"'", *fragments])
    return f"'{namespace}:' || substr(sha256({payload} || ']'), 1, 24)"


def prefixed_scope(name: str) -> str:
    return ", ".join(f"{name}.{c}" for c in BY)


def sql_text(value: str) -> str:
    return f"'\"' || {value} || '\"'"


EVIDENCE_SQL = sql_id(
    "evidence",
    *[sql_text(c) for c in ("artifact_id", "content_hash", "'record'", "collection", "record_key")],
)


def sql_decimal(value: str) -> str:
    return f"regexp_replace(regexp_replace(CAST({value} AS VARCHAR), '0+$', ''), '\\.$', '')"


# ---- scalar functions -----------------------------------------------------------------------


@query(
    "normalize_identifiers",
    f"""SELECT sku, {normalized('sku')} AS identifier_key, count(*) AS line_count FROM {{bom_lines}} GROUP BY sku""",
)
def normalize_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    skus = bind(spark, sf, "bom_lines").groupBy("sku").agg(F.count(F.lit(1)).alias("line_count"))
    return skus.withColumn("identifier_key", normalize_identifier(F.col("sku")))


@query("evidence_ids", f"SELECT artifact_id, record_key, {EVIDENCE_SQL} AS evidence_id FROM {{bom_lines}}")
def evidence_ids(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "bom_lines")
    return lines.select("artifact_id", "record_key", evidence.evidence_id(lines.columns).alias("evidence_id"))


@query(
    "normalize_questions",
    r"""SELECT question_id, trim(regexp_replace(replace(lower(question), '-', ' '), '\s+', ' ', 'g')) AS normalized
FROM (SELECT question_id, replace(question, 'ß', 'ss') AS question FROM {questions})""",
)
def normalize_questions(spark: SparkSession, sf: str) -> DataFrame:
    asked = bind(spark, sf, "questions")
    return asked.select("question_id", normalize_question(F.col("question")).alias("normalized"))


# ---- raw lines ------------------------------------------------------------------------------


@query(
    "bom_assertions",
    f"""SELECT {S}, artifact_id, record_key, sku AS subject_key, 0 AS ordinal, 'has_sku' AS predicate, sku AS value_text FROM {{bom_lines}}
UNION ALL SELECT {S}, artifact_id, record_key, sku, 1, 'has_description', description FROM {{bom_lines}}
UNION ALL SELECT {S}, artifact_id, record_key, sku, 2, 'has_quantity', {sql_decimal('quantity')} FROM {{bom_lines}}
UNION ALL SELECT {S}, artifact_id, record_key, sku, 3, 'has_unit_price', {sql_decimal('unit_price')}
FROM {{bom_lines}} WHERE unit_price IS NOT NULL""",
)
def bom_assertions(spark: SparkSession, sf: str) -> DataFrame:
    made = bom.bom_assertions(bind(spark, sf, "bom_lines"))
    return made.select(*BY, "artifact_id", "record_key", "subject_key", "ordinal", "predicate", "value_text")


def assertion_sql(predicate: str, value: str) -> str:
    evidence_sql = sql_text(f"({EVIDENCE_SQL})")
    return sql_id("assertion", sql_text("sku"), f"'\"{predicate}\"'", sql_text(value), evidence_sql, "'\"document\"'", "'null'")


# what each predicate of a line says, in SQL
SAID = {"has_sku": "sku", "has_description": "description", "has_quantity": sql_decimal("quantity"), "has_unit_price": sql_decimal("unit_price")}


@query(
    "assertion_ids",
    " UNION ALL ".join(
        f"SELECT record_key, '{predicate}' AS predicate, {assertion_sql(predicate, value)} AS assertion_id FROM {{bom_lines}} WHERE {value} IS NOT NULL"
        for predicate, value in SAID.items()
    ),
)
def assertion_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = bom.bom_assertions(bind(spark, sf, "bom_lines"))
    return bom.with_assertion_ids(made).select("record_key", "predicate", "assertion_id")


@query(
    "keyword_lines",
    f"""SELECT {S}, record_key, description, quantity FROM {{bom_lines}}
WHERE contains(lower(description), '{KEYWORD}') AND status <> 'unresolved'""",
)
def keyword_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = bom.usable(bind(spark, sf, "bom_lines"))
    hit = bom.has_keyword(F.col("description"), KEYWORD)
    return lines.where(hit).select(*BY, "record_key", "description", "quantity")


@query(
    "distinct_skus",
    f"""SELECT {S}, sku, count(*) AS evidence_count, 'observed' AS status FROM {{bom_lines}}
WHERE status <> 'unresolved' GROUP BY {S}, sku""",
)
def distinct_skus(spark: SparkSession, sf: str) -> DataFrame:
    return bom.distinct_skus(bind(spark, sf, "bom_lines"))


@query(
    "keyword_quantity",
    f"""SELECT {S}, CAST(coalesce(sum(quantity) FILTER (contains(lower(description), '{KEYWORD}') AND status <> 'unresolved'), 0) AS DECIMAL(38,6)) AS value,
count(*) FILTER (contains(lower(description), '{KEYWORD}') AND status <> 'unresolved') AS evidence_count, 'observed' AS status
FROM {{bom_lines}} GROUP BY {S}""",
)
def keyword_quantity(spark: SparkSession, sf: str) -> DataFrame:
    return bom.keyword_quantity(bind(spark, sf, "bom_lines"), keyword=KEYWORD)


@query(
    "bom_cost",
    f"""WITH bills AS (SELECT DISTINCT {S} FROM {{small_boms}}),
used AS (SELECT {S}, bool_and(unit_price IS NOT NULL) AS priced, sum(CAST(quantity AS DECIMAL(19,6)) * unit_price) AS total, count(*) AS n
FROM {{small_boms}} WHERE status <> 'unresolved' GROUP BY {S})
SELECT {", ".join("b." + c for c in S.split(", "))}, CASE WHEN n IS NULL THEN CAST(0 AS DECIMAL(38,12)) WHEN priced THEN CAST(total AS DECIMAL(38,12)) END AS value,
CASE WHEN n IS NULL OR priced THEN 'observed' ELSE 'unresolved' END AS status, coalesce(n, 0) AS evidence_count
FROM bills b LEFT JOIN used u ON {on_scope('b', 'u')}""",
)
def bom_cost(spark: SparkSession, sf: str) -> DataFrame:
    return bom.bom_cost(bind(spark, sf, "small_boms"))


CONTEXT = RequestContext("analyst", "tenant-1", "project-7", "site-1", frozenset({"read_state", "search"}))


@query(
    "scope_filter",
    """SELECT artifact_id, count(*) AS line_count, CAST(sum(quantity) AS DECIMAL(38,6)) AS quantity FROM {bom_lines}
WHERE tenant_id = 'tenant-1' AND project_id = 'project-7' AND site_id = 'site-1' GROUP BY artifact_id""",
)
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    mine = within(bind(spark, sf, "bom_lines"), CONTEXT)
    return mine.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("quantity").alias("quantity")
    )


# ---- resolution -----------------------------------------------------------------------------


@query(
    "resolve_identifiers",
    f"""WITH {resolved('bom_lines')}
SELECT {", ".join("a." + c for c in S.split(", "))}, a.sku AS mention, a.identifier_key, any_value(canonical_key) AS canonical_key,
any_value(resolution) AS status, any_value(rationale) AS rationale, any_value(b.n) AS evidence_count, count(*) AS line_count
FROM (SELECT *, {normalized('sku')} AS identifier_key FROM res) a
JOIN (SELECT {S}, {normalized('sku')} AS identifier_key, count(*) AS n FROM res GROUP BY ALL) b
ON {on_scope('a', 'b')} AND a.identifier_key = b.identifier_key
GROUP BY {", ".join("a." + c for c in S.split(", "))}, a.sku, a.identifier_key""",
)
def resolve_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.resolve_identifiers(bind(spark, sf, "bom_lines"), bind(spark, sf, "candidates"))


@query(
    "resolution_evidence",
    f"""SELECT {S}, {normalized('sku')} AS identifier_key, count(*) AS assertions, count(DISTINCT sku) AS subjects
FROM {{bom_lines}} GROUP BY {S}, {normalized('sku')}""",
)
def resolution_evidence(spark: SparkSession, sf: str) -> DataFrame:
    made = resolution.resolution_evidence(bom.identifier_assertions(bind(spark, sf, "bom_lines")))
    return made.groupBy(*BY, "identifier_key").agg(
        F.count(F.lit(1)).alias("assertions"), F.count_distinct("subject_key").alias("subjects")
    )


SCOPE_JSON = (
    "'\"StateScope(tenant_id=''' || tenant_id || ''', project_id=''' || project_id || ''', site_id=''' || site_id "
    "|| ''', version=''' || version || ''')\"'"
)
RUN_SQL = sql_id(
    "run", *[f"'\"{v}\"'" if v else "'null'" for v in provenance.LOCAL_RUN.values()], "'[]'"
)


def component_sql(component: tuple[str, str, str]) -> str:
    values = [*component, None, None, None, None, None, None]
    return sql_id(
        "decision-provenance", sql_text(f"({RUN_SQL})"), *[f"'\"{v}\"'" if v else "'null'" for v in values]
    )


SKU_ASSERTION_SQL = assertion_sql("has_sku", "sku")


@query(
    "resolution_decision_ids",
    f"""WITH {resolved('small_boms')},
sup AS (SELECT {S}, {normalized('sku')} AS identifier_key, count(*) AS n,
        list(assertion_id ORDER BY line_no, assertion_id) AS ids
        FROM (SELECT *, {SKU_ASSERTION_SQL} AS assertion_id FROM res) GROUP BY ALL),
dec AS (SELECT DISTINCT {S}, sku AS mention, canonical_key, resolution, rationale FROM res)
SELECT {", ".join("d." + c for c in S.split(", "))}, mention, {sql_id('resolution-decision', sql_text('mention'),
  "coalesce('\"' || canonical_key || '\"', 'null')", sql_text('resolution'), id_part('ids'), sql_text('rationale'),
  sql_text('(' + component_sql(provenance.RESOLVER) + ')'))} AS decision_id
FROM dec d JOIN sup ON {on_scope('d', 'sup')} AND {normalized('mention')} = identifier_key""",
)
def resolution_decision_ids(spark: SparkSession, sf: str) -> DataFrame:
    return decided(spark, sf).select(*BY, "mention", "decision_id")


def decided(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with their identifiers; the decisions are written before the assertions behind them are dealt out."""
    lines = bind(spark, sf, "small_boms")
    decisions = materialize(resolution.resolve_identifiers(lines, bind(spark, sf, "candidates")), "decisions")
    keyed = resolution.resolution_evidence(bom.with_assertion_ids(bom.identifier_assertions(lines)))
    lists = members.id_lists(keyed, [*BY, "identifier_key"], ["line_no"], "assertion_id")
    prov = provenance.component_provenance(provenance.run_id(provenance.local_run()), provenance.RESOLVER)
    joined = decisions.join(lists, [*BY, "identifier_key"], "left")
    return resolution.decision_ids(joined, prov)


DECISIONS_SQL = f"""sup AS (SELECT {S}, {normalized('sku')} AS identifier_key, list(assertion_id ORDER BY line_no, assertion_id) AS ids
        FROM (SELECT *, {SKU_ASSERTION_SQL} AS assertion_id FROM res) GROUP BY ALL),
dec AS (SELECT DISTINCT {S}, sku AS mention, canonical_key, resolution, rationale FROM res),
decided AS (SELECT {prefixed_scope('d')}, mention, canonical_key, {sql_id('resolution-decision', sql_text('mention'),
  "coalesce('\"' || canonical_key || '\"', 'null')", sql_text('resolution'), id_part('ids'), sql_text('rationale'),
  sql_text('(' + component_sql(provenance.RESOLVER) + ')'))} AS decision_id
FROM dec d JOIN sup ON {on_scope('d', 'sup')} AND {normalized('mention')} = identifier_key)"""
SAID_SQL = " UNION ALL ".join(
    f"SELECT {S}, sku, record_key, '{predicate}' AS predicate, {assertion_sql(predicate, value)} AS assertion_id FROM res WHERE {value} IS NOT NULL"
    for predicate, value in SAID.items()
)


@query(
    "canonicalized_assertion_ids",
    f"""WITH {resolved('small_boms')}, {DECISIONS_SQL}, said AS ({SAID_SQL})
SELECT s.record_key, s.predicate, d.canonical_key, {sql_id('canonicalized-assertion', sql_text('s.assertion_id'), sql_text('d.decision_id'),
  SCOPE_JSON.replace("|| ", "|| s.").replace("|| s.'", "|| '"), "strftime(TIMESTAMP '" + CUTOFF + "', '\"%Y-%m-%dT%H:%M:%S+00:00\"')")} AS canonicalized_assertion_id
FROM said s JOIN decided d ON {on_scope('s', 'd')} AND s.sku = d.mention WHERE d.canonical_key IS NOT NULL""",
)
def canonicalized_assertion_ids(spark: SparkSession, sf: str) -> DataFrame:
    # all assertions of a line have its subject, so the line meets the decision before it makes them
    lines = bind(spark, sf, "small_boms").withColumn("subject_key", F.col("sku"))
    known = decided(spark, sf).select(*BY, "mention", "status", "canonical_key", "identifier_key", "decision_id")
    linked = resolution.canonicalized_assertions(lines, materialize(known, "decisions")).drop("subject_key")
    asserted = bom.with_assertion_ids(bom.bom_assertions(linked, located=True))
    made = with_record_id(asserted.withColumn("effective_at", cutoff()), "canonicalized-assertion")
    return made.select("record_key", "predicate", "canonical_key", "canonicalized_assertion_id")


@query(
    "last_decisions",
    f"""WITH {CAND} SELECT mention, ordinal, canonical_key FROM (
SELECT {normalized('sku')} AS mention, line_no AS ordinal, c AS canonical_key,
row_number() OVER (PARTITION BY {normalized('sku')} ORDER BY line_no DESC, record_key DESC) AS place
FROM {{bom_lines}} LEFT JOIN cand ON {normalized('sku')} = k) WHERE place = 1""",
)
def last_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = resolution.resolve_rows(bind(spark, sf, "bom_lines"), bind(spark, sf, "candidates"))
    keys = resolution.candidate_index(bind(spark, sf, "candidates"))
    decisions = rows.select(
        F.col("identifier_key").alias("mention"), F.col("line_no").alias("ordinal"), "record_key"
    )
    last = resolution.last_decisions(
        decisions.withColumn("order", F.struct("ordinal", "record_key")), by=(), ordinal="order"
    )
    named = keys.select(F.col("identifier_key").alias("mention"), F.col("only_candidate").alias("canonical_key"))
    return last.join(named, "mention", "left").select("mention", "ordinal", "canonical_key")


@query(
    "operational_lines",
    f"""WITH {resolved('bom_lines')}
SELECT {S}, canonical_key, sku, artifact_id, record_key, quantity, unit_price FROM res WHERE canonical_key IS NOT NULL""",
)
def operational_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines, candidates = bind(spark, sf, "bom_lines"), bind(spark, sf, "candidates")
    decisions = resolution.resolve_identifiers(lines, candidates)
    columns = [*BY, "canonical_key", "sku", "artifact_id", "record_key", "quantity", "unit_price"]
    return state.operational_lines(lines, decisions).select(*columns)


def resolved_lines(spark: SparkSession, sf: str, name: str = "bom_lines") -> DataFrame:
    rows = resolution.resolve_rows(bind(spark, sf, name), bind(spark, sf, "candidates"))
    return rows.where("resolution = 'resolved'")


@query(
    "canonicalized_assertions",
    f"""WITH {resolved('bom_lines')}
SELECT {S}, canonical_key, sku AS subject_key, record_key, unnest(CASE WHEN unit_price IS NULL
  THEN ['has_sku', 'has_description', 'has_quantity']
  ELSE ['has_sku', 'has_description', 'has_quantity', 'has_unit_price'] END) AS predicate
FROM res WHERE canonical_key IS NOT NULL""",
)
def canonicalized_assertions(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "bom_lines")
    decisions = resolution.resolve_identifiers(lines, bind(spark, sf, "candidates"))
    linked = resolution.canonicalized_assertions(bom.bom_assertions(lines), decisions)
    return linked.select(*BY, "canonical_key", "subject_key", "record_key", "predicate")


# ---- reconciliation -------------------------------------------------------------------------

RECONCILED = (
    f"{S}, canonical_key, CAST(quantity AS DECIMAL(38,6)) AS quantity, CAST(unit_price AS DECIMAL(38,6)) AS unit_price, "
    "governing_source_artifact, source_count, evidence_count, losing_evidence_count, status"
)


@query("reconcile", f"WITH {reconciled('bom_lines')} SELECT {RECONCILED} FROM rec")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return reconciliation.reconcile_lines(resolved_lines(spark, sf), PRECEDENCE)


@query(
    "reconciled_sources",
    f"""WITH {reconciled('bom_lines')} SELECT {S}, canonical_key, artifact_id,
CASE WHEN place = 1 THEN 'governing' ELSE 'losing' END AS role, n AS line_count FROM gov""",
)
def reconciled_sources(spark: SparkSession, sf: str) -> DataFrame:
    return reconciliation.reconciled_sources(resolved_lines(spark, sf), PRECEDENCE)


@query(
    "reconciled_evidence",
    f"""WITH {reconciled('bom_lines')} SELECT {", ".join("r." + c for c in S.split(", "))}, r.canonical_key, record_key,
CASE WHEN r.artifact_id = rec.governing_source_artifact THEN 'governing' ELSE 'losing' END AS role
FROM res r JOIN rec ON {on_scope('r', 'rec')} AND r.canonical_key = rec.canonical_key""",
)
def reconciled_evidence(spark: SparkSession, sf: str) -> DataFrame:
    lines = resolved_lines(spark, sf)
    rows = reconciliation.reconciled_evidence(lines, reconciliation.reconcile_lines(lines, PRECEDENCE))
    return rows.select(*BY, "canonical_key", "record_key", "role")


@query(
    "reconcile_single_source",
    f"""WITH {reconciled('small_boms')}, one AS (SELECT {S} FROM src GROUP BY {S} HAVING count(DISTINCT artifact_id) = 1)
SELECT {RECONCILED} FROM rec WHERE ({S}) IN (SELECT ({S}) FROM one)""",
)
def reconcile_single_source(spark: SparkSession, sf: str) -> DataFrame:
    return reconciliation.reconcile_single_source(resolved_lines(spark, sf, "small_boms"), strict=False)


@query(
    "sources_without_policy",
    f"""WITH {resolved('small_boms')} SELECT {S}, count(DISTINCT artifact_id) AS source_count FROM res
WHERE canonical_key IS NOT NULL GROUP BY {S} HAVING count(DISTINCT artifact_id) > 1""",
)
def sources_without_policy(spark: SparkSession, sf: str) -> DataFrame:
    return reconciliation.sources_without_policy(resolved_lines(spark, sf, "small_boms"))


@query(
    "uncovered_keys",
    f"""WITH {resolved('bom_lines')} SELECT {S}, canonical_key, count(*) AS line_count,
'pil.policy.reconciliation_no_governing_source' AS error_code, 'policy' AS category FROM res
WHERE canonical_key IS NOT NULL GROUP BY {S}, canonical_key HAVING bool_and(artifact_id = 'bom-r.xlsx')""",
)
def uncovered_keys(spark: SparkSession, sf: str) -> DataFrame:
    return reconciliation.uncovered_keys(resolved_lines(spark, sf), PRECEDENCE[:2])


@query(
    "governing_source",
    f"""SELECT {S}, arg_min(artifact_id, artifact_id) AS governing_source FROM {{bom_lines}} GROUP BY {S}""",
)
def governing_source(spark: SparkSession, sf: str) -> DataFrame:
    return reconciliation.governing_sources(bind(spark, sf, "bom_lines"), PRECEDENCE, BY)


@query(
    "expected_requirements",
    f"""WITH {resolved('bom_lines')} SELECT {S}, canonical_key, CAST(sum(quantity) AS DECIMAL(38,6)) AS required_quantity,
count(*) AS evidence_count, TIMESTAMP '{CUTOFF}' AS as_of FROM res WHERE canonical_key IS NOT NULL GROUP BY {S}, canonical_key""",
)
def expected_requirements(spark: SparkSession, sf: str) -> DataFrame:
    return state.expected_requirements(resolved_lines(spark, sf), cutoff())


# ---- run and claims -------------------------------------------------------------------------


def run(spark: SparkSession, sf: str, name: str = "small_boms", share: bool = False) -> bom_run.BomRun:
    return bom_run.run_bom(
        bind(spark, sf, name), bind(spark, sf, "candidates"), PRECEDENCE, keyword=KEYWORD, share=share
    )


RUN_SUMMARY = f"""{reconciled('small_boms')},
summed AS (SELECT {S}, count(*) AS keys, count(*) FILTER (status = 'conflict') AS conflicts FROM rec GROUP BY {S}),
runs AS (SELECT {", ".join("r." + c for c in S.split(", "))}, count(*) AS lines, count(DISTINCT CASE WHEN canonical_key IS NULL THEN sku END) AS unresolved_mentions,
any_value(coalesce(keys, 0)) AS keys, any_value(coalesce(conflicts, 0)) AS conflicts
FROM res r LEFT JOIN summed s ON {on_scope('r', 's')} GROUP BY {", ".join("r." + c for c in S.split(", "))}),
statuses AS (SELECT *, CASE WHEN keys = 0 THEN 'unresolved' WHEN conflicts > 0 THEN 'conflict' ELSE 'reconciled' END AS run_status FROM runs)"""


@query(
    "bom_run_summary",
    f"""WITH {RUN_SUMMARY} SELECT {S}, lines, keys, conflicts, run_status,
CASE WHEN unresolved_mentions = 0 THEN 'resolved' ELSE 'partially_resolved' END AS resolution_status FROM statuses""",
)
def bom_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    done = F.when(F.col("unresolved") == 0, "resolved").otherwise("partially_resolved")
    return run(spark, sf).summary.select(*BY, "lines", "keys", "conflicts", "run_status", done.alias("resolution_status"))


@query(
    "bom_status",
    f"WITH {RUN_SUMMARY} SELECT run_status, count(*) AS scopes, CAST(sum(lines) AS BIGINT) AS lines FROM statuses GROUP BY run_status",
)
def bom_status(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).summary.groupBy("run_status").agg(
        F.count(F.lit(1)).alias("scopes"), F.sum("lines").alias("lines")
    )


def chain_sql(table_name: str, claim: str, statuses: list[str], part: str) -> str:
    nodes = [
        sql_id("evidence-node", f"'\"{kind}\"'", f"'\"{label}\"'", sql_text(status), part)
        for (kind, label), status in zip(evidence.CHAIN_STEPS, statuses)
    ]
    named = ", ".join(f"{node} AS node_{i}" for i, node in enumerate(nodes))
    listed = " || ',' || ".join(sql_text(f"node_{i}") for i in range(4))
    chain = sql_id("evidence-chain", sql_text(claim), f"'[' || {listed} || ']'")
    return f"(SELECT *, {chain} AS chain_id FROM (SELECT *, {named} FROM {table_name}))"


@query(
    "evidence_chain",
    f"""WITH {RUN_SUMMARY},
ev AS (SELECT {S}, count(*) AS n, list(evidence_id ORDER BY line_no, evidence_id) AS ids
       FROM (SELECT *, {EVIDENCE_SQL} AS evidence_id FROM res) GROUP BY {S}),
parts AS (SELECT s.*, CASE WHEN unresolved_mentions = 0 THEN 'resolved' ELSE 'partially_resolved' END AS s1,
          CASE WHEN keys > 0 THEN 'observed' ELSE 'unresolved' END AS s2, {id_part('ids')} AS part
          FROM statuses s JOIN ev ON {on_scope('s', 'ev')})
SELECT {S}, chain_id, node_0 AS first_node_id, node_3 AS last_node_id, s1 AS resolution_status
FROM {chain_sql('parts', "'" + bom_run.RUN_CLAIM + "'", ["'observed'", 's1', 's2', 'run_status'], 'part')}""",
)
def evidence_chain(spark: SparkSession, sf: str) -> DataFrame:
    chained = bom_run.run_chain(bind(spark, sf, "small_boms"), run(spark, sf, share=True).summary)
    return chained.select(
        *BY,
        "chain_id",
        F.col("nodes")[0]["node_id"].alias("first_node_id"),
        F.col("nodes")[3]["node_id"].alias("last_node_id"),
        F.col("nodes")[1]["status"].alias("resolution_status"),
    )


@query(
    "source_chain",
    f"""WITH ev AS (SELECT artifact_id, count(*) AS n, list(evidence_id ORDER BY line_no, evidence_id) AS ids
       FROM (SELECT *, {EVIDENCE_SQL} AS evidence_id FROM {{bom_lines}}) GROUP BY artifact_id),
nodes AS (SELECT artifact_id, n AS evidence_count, {sql_id('evidence-node', "'\"source_assertion\"'",
  "'\"source assertions\"'", "'\"observed\"'", id_part('ids'))} AS node_id FROM ev),
chains AS (SELECT *, {sql_id('evidence-chain', sql_text('artifact_id'), "'[\"' || node_id || '\"]'")} AS chain_id FROM nodes)
SELECT artifact_id, evidence_count, chain_id, {sql_id('claim', sql_text('artifact_id'), sql_text('chain_id'))} AS claim_id FROM chains""",
)
def source_chain(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "bom_lines")
    located = lines.withColumn("evidence_id", evidence.evidence_id(lines.columns))
    lists = members.id_lists(located, ["artifact_id"], ["line_no"])
    chained = evidence.source_chain(lists, F.col("artifact_id"))
    return chained.select("artifact_id", F.col("id_count").alias("evidence_count"), "chain_id", "claim_id")


CLAIM_COLUMNS = (
    f"{S}, kind, status, value, key_count, evidence_count, resolution_status, state_status, reconciliation_status"
)


@query("claims", f"WITH {claimed('small_boms')} SELECT {CLAIM_COLUMNS} FROM claims")
def claims_query(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).claims


def one_claim(kind: str):
    def one(spark: SparkSession, sf: str) -> DataFrame:
        rows = run(spark, sf).claims.where(F.col("kind") == kind)
        return rows.select(*BY, "status", "value", "key_count", "evidence_count")

    query(
        {"gpu_quantity": "claim_keyword_quantity"}.get(kind, f"claim_{kind}"),
        f"WITH {claimed('small_boms')} SELECT {S}, status, value, key_count, evidence_count FROM claims WHERE kind = '{kind}'",
    )(one)


for _kind in ("distinct_skus", "gpu_quantity", "bom_cost"):
    one_claim(_kind)


def small_keys(spark: SparkSession, sf: str, share: bool = False) -> DataFrame:
    return claims.reconciled_keys(
        bind(spark, sf, "small_boms"), bind(spark, sf, "candidates"), PRECEDENCE, keyword=KEYWORD, share=share
    )


@query(
    "claim_keys",
    f"""WITH {claimed('small_boms')} SELECT {S}, canonical_key FROM rec
WHERE ({S}) IN (SELECT ({S}) FROM claims WHERE kind = 'distinct_skus' AND status = 'reconciled')""",
)
def claim_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = small_keys(spark, sf)
    made = claims.claims_from_summary(claims.scope_summary(keys))
    return claims.claim_keys(keys, made)


@query(
    "claim_state_lines",
    f"""WITH {claimed('small_boms')} SELECT {", ".join("r." + c for c in S.split(", "))}, r.canonical_key, r.record_key, rec.status
FROM res r JOIN rec ON {on_scope('r', 'rec')} AND r.canonical_key = rec.canonical_key
JOIN keyed k ON {on_scope('k', 'r')} AND k.canonical_key = r.canonical_key AND k.kind = 'gpu_quantity'""",
)
def claim_state_lines(spark: SparkSession, sf: str) -> DataFrame:
    keys = small_keys(spark, sf).where("canonical_key is not null and keyword_lines > 0")
    lines = resolved_lines(spark, sf, "small_boms")
    return lines.select(*BY, "canonical_key", "record_key").join(
        keys.select(*BY, "canonical_key", "status"), [*BY, "canonical_key"]
    )


CLAIM_IDS = f"""{claimed('small_boms')},
located AS (SELECT kind, {S}, line_no, {EVIDENCE_SQL} AS evidence_id FROM sub),
ev AS (SELECT {S}, kind, count(*) AS n, list(evidence_id ORDER BY line_no, evidence_id) AS ids
       FROM located GROUP BY {S}, kind),
named AS (SELECT {S}, {sql_entries('list(canonical_key ORDER BY canonical_key)')} AS names FROM rec GROUP BY {S}),
parts AS (SELECT c.*, coalesce({id_part('ids')}, '[]') AS part,
          CASE WHEN c.value IS NOT NULL THEN {sql_decimal('c.value')}
               WHEN c.key_count = 1 THEN '(''' || names[1] || ''',)'
               WHEN c.key_count > 1 THEN '(''' || array_to_string(names, ''', ''') || ''')'
               ELSE 'None' END AS printed
          FROM claims c LEFT JOIN ev ON {on_scope('c', 'ev')} AND c.kind = ev.kind LEFT JOIN named m ON {on_scope('c', 'm')}),
chained AS (SELECT * FROM {chain_sql('parts', 'kind', ["'observed'", 'resolution_status', 'state_status', 'reconciliation_status'], 'part')}),
identified AS (SELECT *, {sql_id('claim', sql_text('kind'), sql_text('printed'), sql_text('status'), sql_text('chain_id'), 'part')} AS claim_id FROM chained)"""


def identified_claims(spark: SparkSession, sf: str) -> DataFrame:
    return claim_register.register_claims(
        bind(spark, sf, "small_boms"), bind(spark, sf, "candidates"), PRECEDENCE, keyword=KEYWORD
    )


@query(
    "claim_ids",
    f"WITH {CLAIM_IDS} SELECT {S}, kind, status, chain_id, claim_id FROM identified",
)
def claim_ids(spark: SparkSession, sf: str) -> DataFrame:
    return identified_claims(spark, sf).select(*BY, "kind", "status", "chain_id", "claim_id")


@query(
    "review_context",
    f"""WITH {CLAIM_IDS} SELECT claim_id, kind AS claim_kind, status AS claim_status, evidence_count, chain_id,
node_0 || ' ' || node_1 || ' ' || node_2 || ' ' || node_3 AS node_ids, CASE part WHEN '[]' THEN '' ELSE replace(part[3:-3], '","', ' ') END AS evidence_entries,
'wrong_result source_issue mapping_issue resolution_issue stale_result' AS allowed_reasons FROM identified""",
)
def review_context(spark: SparkSession, sf: str) -> DataFrame:
    shown = claims.review_context(identified_claims(spark, sf))
    return shown.select(
        "claim_id",
        "claim_kind",
        "claim_status",
        "evidence_count",
        "chain_id",
        F.array_join("node_ids", " ").alias("node_ids"),
        F.array_join("evidence_entries", " ").alias("evidence_entries"),
        F.array_join("allowed_reasons", " ").alias("allowed_reasons"),
    )


@query(
    "review_evidence",
    f"""WITH {CLAIM_IDS} SELECT {prefixed_scope('c')}, claim_id, line_no, evidence_id
FROM identified c JOIN located l ON {on_scope('c', 'l')} AND c.kind = l.kind""",
)
def review_evidence(spark: SparkSession, sf: str) -> DataFrame:
    cited = claims.claim_evidence(bind(spark, sf, "small_boms"), keyword=KEYWORD)
    return claims.review_evidence(identified_claims(spark, sf), cited)


@query(
    "route_questions",
    rf"""WITH q AS (SELECT *, trim(regexp_replace(replace(lower(question), '-', ' '), '\s+', ' ', 'g')) AS t FROM {{questions}})
SELECT question_id, CASE WHEN contains(t, '{KEYWORD}') AND (contains(t, 'how many') OR contains(t, 'quantity')) THEN 'gpu_quantity'
WHEN contains(t, 'cost') OR contains(t, 'price') OR contains(t, 'total') THEN 'bom_cost'
WHEN contains(t, 'sku') THEN 'distinct_skus' END AS kind FROM q""",
)
def route_questions(spark: SparkSession, sf: str) -> DataFrame:
    asked = bind(spark, sf, "questions")
    return asked.select(
        "question_id", claims.route(normalize_question(F.col("question")), KEYWORD).alias("kind")
    )


@query(
    "answer_questions",
    rf"""WITH {claimed('small_boms')},
q AS (SELECT *, trim(regexp_replace(replace(lower(question), '-', ' '), '\s+', ' ', 'g')) AS t FROM {{questions}}),
routed AS (SELECT *, CASE WHEN contains(t, '{KEYWORD}') AND (contains(t, 'how many') OR contains(t, 'quantity')) THEN 'gpu_quantity'
WHEN contains(t, 'cost') OR contains(t, 'price') OR contains(t, 'total') THEN 'bom_cost'
WHEN contains(t, 'sku') THEN 'distinct_skus' END AS kind FROM q)
SELECT question_id, r.kind, CASE WHEN r.kind IS NULL THEN 'unsupported' ELSE 'routed' END AS route_status,
c.status AS claim_status, c.value, c.key_count FROM routed r LEFT JOIN claims c ON {on_scope('r', 'c')} AND r.kind = c.kind""",
)
def answer_questions(spark: SparkSession, sf: str) -> DataFrame:
    answered = claims.answer_questions(bind(spark, sf, "questions"), run(spark, sf).claims, keyword=KEYWORD)
    return answered.select("question_id", "kind", "route_status", "claim_status", "value", "key_count")


@query(
    "evidence_lookup",
    f"""WITH located AS (SELECT *, {EVIDENCE_SQL} AS evidence_id FROM {{bom_lines}}),
wanted AS (SELECT DISTINCT CASE WHEN l_orderkey % 2 = 0 THEN evidence_id ELSE evidence_id || 'x' END AS evidence_id FROM located)
SELECT w.evidence_id, l.sku, l.quantity, CASE WHEN l.sku IS NULL THEN 'unknown' ELSE 'found' END AS lookup
FROM wanted w LEFT JOIN located l ON w.evidence_id = l.evidence_id""",
)
def evidence_lookup(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "bom_lines")
    known = evidence.evidence_id(lines.columns)
    asked = lines.select(
        F.when(F.col("l_orderkey") % 2 == 0, known).otherwise(F.concat(known, F.lit("x"))).alias("evidence_id")
    )
    found, missing = evidence.lookup_evidence(lines, asked)
    hit = found.select("evidence_id", "sku", "quantity", F.lit("found").alias("lookup"))
    none = F.lit(None)
    miss = missing.select(
        "evidence_id",
        none.cast("string").alias("sku"),
        none.cast("decimal(18,6)").alias("quantity"),
        F.lit("unknown").alias("lookup"),
    )
    return hit.unionByName(miss)


@query(
    "provenance_dims",
    f"""WITH r AS (SELECT 'run-' || s_suppkey AS run_id, 'rev-' || s_nationkey AS rev FROM supplier),
c AS (SELECT run_id, {sql_id('run', sql_text('run_id'), "'\"bom-pipeline\"'", "'\"dev\"'", sql_text('rev'), "'\"local\"'", "'\"local\"'", "'null'", "'[\"artifact:' || run_id || '\"]'")} AS context_id FROM r)
SELECT run_id, context_id, n AS component_name, {sql_id('decision-provenance', sql_text('context_id'), sql_text('n'), "'\"deterministic\"'", "'\"1\"'", "'null'", "'null'", "'null'", "'null'", "'null'", "'null'")} AS provenance_id
FROM c CROSS JOIN (VALUES ('normalized-exact-resolver'), ('deterministic-reconciliation')) t(n)""",
)
def provenance_dims(spark: SparkSession, sf: str) -> DataFrame:
    row = provenance.local_run(F.array(F.concat(F.lit("artifact:run-"), F.col("s_suppkey").cast("string"))))
    row["run_id"] = F.concat(F.lit("run-"), F.col("s_suppkey").cast("string"))
    row["code_revision"] = F.concat(F.lit("rev-"), F.col("s_nationkey").cast("string"))
    runs = table(spark, sf, "supplier").select(*[value.alias(name) for name, value in row.items()])
    steps = F.array(
        *[
            F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(provenance.COMPONENT_PARTS, [*step] + [None] * 6)])
            for step in (provenance.RESOLVER, provenance.RECONCILER)
        ]
    )
    components = runs.select("run_id", F.inline(steps))
    found = provenance.decision_provenance(runs, components)
    return found.select("run_id", "context_id", "component_name", "provenance_id")



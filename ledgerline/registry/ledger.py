"""Queries over the ledger, retrieval, documents, sources, exports and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import decimal_text
from ledgerline.operators import documents, ledger, metrics, provenance, retrieval
from ledgerline.operators.evidence import CHAIN_STEPS, evidence_id, record_evidence_id
from ledgerline.operators.members import id_lists
from ledgerline.operators.reconciliation import reconcile_lines
from ledgerline.operators.record_ids import with_record_id
from ledgerline.operators.scope import RequestContext
from ledgerline.plans import bom_run
from ledgerline.registry.base import S, on_scope, query
from ledgerline.registry.bom import (
    BY,
    EVIDENCE_SQL,
    RECONCILED,
    RUN_SUMMARY,
    SCOPE_JSON,
    chain_sql,
    claimed,
    component_sql,
    cutoff,
    id_part,
    reconciled,
    resolved_lines,
    sql_decimal,
    sql_id,
    sql_text,
)
from ledgerline.registry.state import AT
from ledgerline.session import scratch_path, ship_package
from ledgerline.sources import jsonl, workbooks
from ledgerline.sources.bindings import KEYWORD, PRECEDENCE, bind, inline, run_sql, table
from ledgerline.streaming import ledger as streams

# ---- ledger ---------------------------------------------------------------------------------


@query(
    "ledger_append",
    """SELECT assertion_id, row_number() OVER (ORDER BY observed_at, assertion_id) + 1000 AS sequence, observed_at FROM {event_assertions}""",
)
def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    # every fourth assertion arrives twice; the ledger takes it once
    batch = bind(spark, sf, "event_assertions")
    twice = batch.unionByName(batch.where("event_id % 4 = 0"))
    return ledger.append_entries(twice, None, base=1000).select("assertion_id", "sequence", "observed_at")


@query(
    "ledger_entries",
    "SELECT sequence, assertion_id, subject_key, predicate, value_text, observed_at FROM {event_ledger}",
)
def ledger_entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger.in_order(bind(spark, sf, "event_ledger"))
    return rows.select("sequence", "assertion_id", "subject_key", "predicate", "value_text", "observed_at")


@query("ledger_as_of", f"SELECT sequence, subject_key, predicate FROM {{event_ledger}} WHERE observed_at <= {AT}")
def ledger_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.as_of(bind(spark, sf, "event_ledger"), cutoff()).select("sequence", "subject_key", "predicate")


ISO = (
    "strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(observed_at, '%f') = '000000' THEN '' "
    "ELSE '.' || strftime(observed_at, '%f') END || '+00:00'"
)
ENTRY_SQL = sql_id("assertion-entry", "CAST(sequence AS VARCHAR)", sql_text("assertion_id"), sql_text(f"({ISO})"))


@query("ledger_entry_ids", f"SELECT sequence, {ENTRY_SQL} AS entry_id FROM {{event_ledger}}")
def ledger_entry_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bind(spark, sf, "event_ledger").select("sequence", ledger.entry_id().alias("entry_id"))


# ---- retrieval ------------------------------------------------------------------------------

SEARCHER = RequestContext("analyst", "tenant-1", "project-3", "site-1", frozenset({"search"}))
BUILT_AT = "2024-02-01T00:00:00+00:00"


def built_at():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def manifest_of(spark: SparkSession, sf: str, projection_id: str = "ledger-lexical") -> DataFrame:
    entries = bind(spark, sf, "event_ledger").withColumn("entry_id", ledger.entry_id())
    return retrieval.build_manifest(entries, projection_id, "1", "cfg", built_at(), SEARCHER)


def manifest_id_sql(status: str, reason: str, recorded: str) -> str:
    return sql_id(
        "projection-manifest",
        "'\"ledger-lexical\"'",
        "'\"lexical\"'",
        "'\"1\"'",
        "'\"cfg\"'",
        "source_entries",
        sql_text("newest"),
        f"'\"{status}\"'",
        f"'\"{recorded}\"'",
        "'\"tenant-1\"'",
        "'\"project-3\"'",
        "'\"site-1\"'",
        reason,
    )


MANIFEST = f"""e AS (SELECT *, {ENTRY_SQL} AS hashed FROM {{event_ledger}}),
m AS (SELECT count(*) AS n, list(hashed ORDER BY sequence) AS ids, max(observed_at) AS source_as_of FROM e),
p AS (SELECT n AS source_entry_count, source_as_of, {id_part('ids')} AS source_entries, {ISO.replace('observed_at', 'source_as_of')} AS newest FROM m)"""


@query(
    "projection_build",
    f"""WITH {MANIFEST} SELECT 'ledger-lexical' AS projection_id, source_entry_count, source_as_of, 'ready' AS status,
{manifest_id_sql('ready', "'null'", BUILT_AT)} AS manifest_id FROM p""",
)
def projection_build(spark: SparkSession, sf: str) -> DataFrame:
    return manifest_of(spark, sf).select(
        "projection_id", "source_entry_count", "source_as_of", "status", "manifest_id"
    )


@query(
    "projection_lifecycle",
    f"""WITH {MANIFEST} SELECT 1 AS write_seq, 'ready' AS status, {manifest_id_sql('ready', "'null'", BUILT_AT)} AS manifest_id, CAST(NULL AS VARCHAR) AS failure_reason FROM p
UNION ALL SELECT 2, 'failed', {manifest_id_sql('failed', "'" + '"' + "disk full" + '"' + "'", '2024-02-02T00:00:00+00:00')}, 'disk full' FROM p
UNION ALL SELECT 3, 'deleted', {manifest_id_sql('deleted', "'null'", '2024-02-03T00:00:00+00:00')}, NULL FROM p""",
)
def projection_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    ready = manifest_of(spark, sf)
    failed = retrieval.next_manifest(ready, "failed", F.lit("2024-02-02 00:00:00").cast("timestamp"), "disk full")
    deleted = retrieval.next_manifest(failed, "deleted", F.lit("2024-02-03 00:00:00").cast("timestamp"))
    written = [m.withColumn("write_seq", F.lit(i)) for i, m in enumerate((ready, failed, deleted), start=1)]
    history = written[0].unionByName(written[1]).unionByName(written[2])
    return history.select("write_seq", "status", "manifest_id", "failure_reason")


# manifests per user: built, sometimes failed or deleted, sometimes built again
MANIFEST_LOG = """SELECT subject_key AS projection_id, event_id AS write_seq,
CASE predicate WHEN 'error' THEN 'failed' WHEN 'click' THEN 'deleted' ELSE 'ready' END AS status, observed_at AS recorded_at
FROM {event_ledger}"""


@query(
    "projection_status",
    f"""SELECT projection_id, arg_max(status, write_seq) AS status, max(write_seq) AS write_seq FROM ({MANIFEST_LOG}) GROUP BY projection_id""",
)
def projection_status(spark: SparkSession, sf: str) -> DataFrame:
    log = run_sql(spark, sf, inline(MANIFEST_LOG))
    return retrieval.latest_manifests(log).select("projection_id", "status", "write_seq")


@query(
    "live_index",
    f"""WITH now AS (SELECT projection_id, arg_max(status, write_seq) AS status FROM ({MANIFEST_LOG}) GROUP BY projection_id)
SELECT subject_key AS projection_id, count(*) AS entries FROM {{event_ledger}} WHERE subject_key IN (SELECT projection_id FROM now WHERE status = 'ready') GROUP BY 1""",
)
def live_index(spark: SparkSession, sf: str) -> DataFrame:
    index = bind(spark, sf, "event_ledger").withColumn("projection_id", F.col("subject_key"))
    log = run_sql(spark, sf, inline(MANIFEST_LOG))
    live = retrieval.live_index(index, log)
    return live.groupBy("projection_id").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "ledger_search",
    """WITH t AS (SELECT entry_id, lower(subject_key || ' ' || predicate || ' ' || value_text) AS text FROM {event_ledger}),
s AS (SELECT entry_id, (contains(text, 'user-1')::INT + contains(text, 'purchase')::INT + contains(text, '2.5')::INT + contains(text, 'user-1')::INT) / 4.0::DOUBLE AS score FROM t)
SELECT entry_id, score FROM s WHERE score > 0 ORDER BY score DESC, entry_id LIMIT 25""",
)
def ledger_search(spark: SparkSession, sf: str) -> DataFrame:
    index = retrieval.build_index(bind(spark, sf, "event_ledger"), "ledger-lexical")
    manifest = {"projection_id": "ledger-lexical", "status": "ready", "manifest_id": "m", **SEARCHER.scope()}
    hits = retrieval.search(index, manifest, "USER-1 purchase 2.5 user-1", SEARCHER, limit=25)
    return hits.select("entry_id", "score")


BATCH_HITS = r"""t AS (SELECT entry_id, subject_key, lower(subject_key || ' ' || predicate || ' ' || value_text) AS text FROM {event_ledger}),
q AS (SELECT query_id, list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '') AS terms FROM {search_queries}),
s AS (SELECT query_id, entry_id, subject_key, len(list_filter(terms, lambda x: contains(text, x))) / len(terms) AS score FROM q CROSS JOIN t),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20)"""


def batch_hits(spark: SparkSession, sf: str) -> DataFrame:
    index = retrieval.build_index(bind(spark, sf, "event_ledger"), "ledger-lexical")
    return retrieval.search_batch(index, bind(spark, sf, "search_queries"), limit=20)


@query("ledger_search_batch", f"WITH {BATCH_HITS} SELECT query_id, entry_id, score, rank FROM hits")
def ledger_search_batch(spark: SparkSession, sf: str) -> DataFrame:
    return batch_hits(spark, sf)


@query(
    "retrieval_metrics",
    f"""WITH {BATCH_HITS}, j AS (SELECT query_id, entry_id FROM {{search_queries}} JOIN {{event_ledger}} ON subject_key = 'user-' || substr(query_id, 2) AND predicate IN ('purchase', 'view', 'signup')),
rel AS (SELECT query_id, count(*) AS relevant FROM j GROUP BY 1),
f AS (SELECT h.query_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg FROM hits h JOIN j ON h.query_id = j.query_id AND h.entry_id = j.entry_id WHERE rank <= 10 GROUP BY 1),
i AS (SELECT query_id, sum(1 / log2(r + 1)) AS best FROM (SELECT query_id, unnest(range(1, least(relevant, 10) + 1)) AS r FROM rel) GROUP BY 1)
SELECT rel.query_id, relevant, coalesce(found, 0) AS found, coalesce(found, 0)::DOUBLE / relevant AS recall, round(coalesce(dcg, 0) / best, 9) AS ndcg
FROM rel JOIN i ON rel.query_id = i.query_id LEFT JOIN f ON rel.query_id = f.query_id""",
)
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    user = F.concat(F.lit("user-"), F.expr("substr(query_id, 2)"))
    asked = bind(spark, sf, "search_queries").select("query_id", user.alias("subject_key"))
    relevant = bind(spark, sf, "event_ledger").where("predicate in ('purchase', 'view', 'signup')")
    judged = relevant.join(asked, "subject_key").select("query_id", "entry_id")
    return metrics.retrieval_metrics(batch_hits(spark, sf), judged, 10)


# ---- documents ------------------------------------------------------------------------------

DOCUMENT_SCOPE = "'\"StateScope(tenant_id=''tenant-1'', project_id=''' || lang || ''', site_id=''site-1'', version=''r1'')\"'"
REFERENCE_SQL = sql_id(
    "source-reference",
    sql_text("source"),
    "'\"doc://' || doc_id || '\"'",
    DOCUMENT_SCOPE,
    "'\"2024-01-01T00:00:00+00:00\"'",
    "'null'",
)


@query(
    "capture_artifacts",
    f"""WITH r AS (SELECT *, {REFERENCE_SQL} AS reference_id, sha256(text) AS content_hash, strlen(text) AS byte_length FROM documents WHERE doc_id % 50 <> 7)
SELECT doc_id, reference_id, content_hash, byte_length, {sql_id('artifact', sql_text('reference_id'), sql_text('content_hash'), "'\"text/plain\"'",
 'CAST(byte_length AS VARCHAR)', "'\"2024-01-02T00:00:00+00:00\"'", sql_text('(' + component_sql(('capture', 'deterministic', '1')) + ')'))} AS artifact_id FROM r""",
)
def capture_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return captured(spark, sf)[0].select("doc_id", "reference_id", "content_hash", "byte_length", "artifact_id")


@query(
    "rejected_captures",
    f"""WITH r AS (SELECT *, {REFERENCE_SQL.replace("2024-01-01T", "2024-03-01T")} AS reference_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 50 = 7)
SELECT doc_id, reference_id, content_hash, TIMESTAMP '2024-03-01' AS observed_at, 'captured before it was observed' AS rejection FROM r""",
)
def rejected_captures(spark: SparkSession, sf: str) -> DataFrame:
    return captured(spark, sf)[1].select("doc_id", "reference_id", "content_hash", "observed_at", "rejection")


def captured(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").withColumn(
        "source_uri", F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    )
    late = F.when(F.col("doc_id") % 50 == 7, "2024-03-01 00:00:00").otherwise("2024-01-01 00:00:00")
    references = docs.select(
        "doc_id",
        "source_uri",
        F.col("source").alias("source_system"),
        F.lit("tenant-1").alias("tenant_id"),
        F.col("lang").alias("project_id"),
        F.lit("site-1").alias("site_id"),
        F.lit("r1").alias("version"),
        late.cast("timestamp").alias("observed_at"),
        F.lit(None).cast("string").alias("source_version"),
    )
    contents = docs.select(
        "source_uri",
        F.sha2("text", 256).alias("content_hash"),
        F.lit("text/plain").alias("media_type"),
        F.octet_length("text").cast("bigint").alias("byte_length"),
        F.lit("2024-01-02 00:00:00").cast("timestamp").alias("captured_at"),
    )
    prov = provenance.component_provenance(
        provenance.run_id(provenance.local_run()), ("capture", "deterministic", "1")
    )
    return documents.capture(references, contents, prov)


ELEMENTS = """el AS (SELECT 'doc-' || doc_id AS artifact_id, unnest(range(len(string_split(text, chr(10))))) AS ordinal,
unnest(string_split(text, chr(10))) AS text FROM documents),
elements AS (SELECT *, artifact_id || '#' || ordinal AS element_id, CASE WHEN ordinal = 0 THEN 'heading' ELSE 'line' END AS kind FROM el)"""


def elements(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("artifact_id"),
        F.lit("hash").alias("content_hash"),
        "text",
    )
    return documents.structure(docs, "documents", F.when(F.col("ordinal") == 0, "heading").otherwise("line"))


@query("structure_documents", f"WITH {ELEMENTS} SELECT element_id, kind, ordinal, text FROM elements")
def structure_documents(spark: SparkSession, sf: str) -> DataFrame:
    return elements(spark, sf).select("element_id", "kind", "ordinal", "text")


MAPPING = "VALUES ('heading', 'title', 'notes-v1'), ('line', 'body', 'notes-v1'), ('line', 'remark', 'notes-v1')"
MAPPED = f"""{ELEMENTS}, mapping AS (SELECT * FROM ({MAPPING}) t(kind, field_name, mapping_schema)),
mapped AS (SELECT element_id || '/' || field_name AS field_key, field_name, CASE WHEN trim(text) <> '' THEN text END AS raw_value,
CASE WHEN trim(text) <> '' THEN 'observed' ELSE 'unresolved' END AS status, CASE WHEN trim(text) = '' THEN 'source element is empty' END AS diagnostic
FROM elements e JOIN mapping m ON e.kind = m.kind)"""


@query("map_fields", f"WITH {MAPPED} SELECT field_key, field_name, raw_value, status, diagnostic FROM mapped")
def map_fields(spark: SparkSession, sf: str) -> DataFrame:
    mapping = spark.sql(f"SELECT * FROM {MAPPING} t(kind, field_name, mapping_schema)")
    mapped = documents.map_fields(elements(spark, sf), mapping)
    return mapped.select("field_key", "field_name", "raw_value", "status", "diagnostic")


RECORD = "CAST(l_orderkey AS STRING)||'-'||CAST(l_linenumber AS STRING)||'-'||CAST(l_partkey AS STRING)||'-'||CAST(l_suppkey AS STRING)"
RAW_FIELDS = f"""SELECT {RECORD} AS record_key, 'quantity' AS field_name,
CASE WHEN l_partkey % 37 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS STRING)||'.50' END AS raw_value FROM lineitem
UNION ALL SELECT {RECORD}, 'weight', CAST(l_partkey AS STRING) FROM lineitem
UNION ALL SELECT {RECORD}, 'ship_date', CASE WHEN l_partkey % 41 <> 0 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) END FROM lineitem
UNION ALL SELECT {RECORD}, 'flag', l_returnflag FROM lineitem"""
FIELD_TYPES = (
    "VALUES ('quantity', 'decimal', 'each', CAST(1 AS DECIMAL(9,6))), ('weight', 'decimal', 'kg', CAST(0.001 AS DECIMAL(9,6))), "
    "('ship_date', 'date', NULL, NULL), ('flag', 'text', NULL, NULL)"
)
NORMALIZED = f"""raw AS ({RAW_FIELDS}), ty AS (SELECT * FROM ({FIELD_TYPES}) t(field_name, value_type, unit, factor)),
typed AS (SELECT record_key, raw.field_name, unit, raw_value, value_type,
CASE WHEN value_type = 'decimal' THEN CAST(TRY_CAST(raw_value AS DECIMAL(18,6)) * factor AS DECIMAL(38,12)) END AS num,
CASE WHEN value_type = 'date' THEN TRY_CAST(raw_value AS DATE) END AS date, CASE WHEN value_type = 'text' THEN raw_value END AS text_value
FROM raw LEFT JOIN ty ON raw.field_name = ty.field_name),
obs AS (SELECT *, CASE WHEN num IS NULL AND date IS NULL AND text_value IS NULL THEN 'unresolved' ELSE 'observed' END AS status,
CASE WHEN raw_value IS NULL THEN 'source field is missing' WHEN value_type IS NULL THEN 'field is not declared' WHEN num IS NULL AND date IS NULL AND text_value IS NULL THEN 'value does not parse as declared' END AS diagnostic FROM typed)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    fields = run_sql(spark, sf, RAW_FIELDS).withColumn("status", F.lit("")).withColumn("diagnostic", F.lit(""))
    types = spark.sql(f"SELECT * FROM {FIELD_TYPES} t(field_name, value_type, unit, factor)")
    return documents.normalize(fields, types)


@query(
    "normalize_observations",
    f"WITH {NORMALIZED} SELECT record_key, field_name, unit, num, date, text_value, status, diagnostic FROM obs",
)
def normalize_observations(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).select(
        "record_key", "field_name", "unit", "num", "date", "text_value", "status", "diagnostic"
    )


@query(
    "extraction_metrics",
    f"""WITH {NORMALIZED}, got AS (SELECT record_key, field_name, CASE WHEN num IS NOT NULL THEN CAST(CAST(num AS BIGINT) AS VARCHAR) WHEN date IS NOT NULL THEN CAST(date AS VARCHAR) ELSE text_value END AS value FROM obs),
gold AS (SELECT record_key, field_name, CASE WHEN field_name = 'flag' THEN 'R' WHEN field_name = 'quantity' THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE raw_value END AS gold_value FROM obs WHERE field_name <> 'weight'),
j AS (SELECT coalesce(got.field_name, gold.field_name) AS field_name, value, gold_value FROM got FULL JOIN gold ON got.record_key = gold.record_key AND got.field_name = gold.field_name),
t AS (SELECT field_name, count(*) AS fields, count(value) AS extracted, count(gold_value) AS gold, count(*) FILTER (value = gold_value) AS correct, count(*) FILTER (value IS NULL) AS abstained FROM j GROUP BY 1)
SELECT *, correct::DOUBLE / nullif(extracted, 0) AS precision, correct::DOUBLE / nullif(gold, 0) AS recall, abstained::DOUBLE / fields AS abstention_rate FROM t""",
)
def extraction_metrics(spark: SparkSession, sf: str) -> DataFrame:
    seen = observations(spark, sf)
    whole = F.round("num").cast("bigint").cast("string")
    value = F.coalesce(whole, F.col("date").cast("string"), F.col("text_value"))
    got = seen.select("record_key", "field_name", value.alias("value"))
    right = F.when(F.col("field_name") == "flag", "R").when(F.col("field_name") == "quantity", whole)
    gold = seen.where("field_name <> 'weight'").select(
        "record_key",
        "field_name",
        F.when(F.col("field_name").isin("flag", "quantity"), right).otherwise(F.col("raw_value")).alias("gold_value"),
    )
    return metrics.extraction_metrics(got, gold, ["field_name"], ["record_key", "field_name"])


@query(
    "entity_mentions",
    f"""SELECT {S}, subject_key AS text, predicate AS entity_type, count(*) AS assertion_count, max(observed_at) AS observed_at
FROM {{event_assertions}} GROUP BY {S}, subject_key, predicate""",
)
def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return documents.entity_mentions(bind(spark, sf, "event_assertions"), entity_type="predicate")


@query(
    "entity_mention_ids",
    f"""WITH g AS (SELECT {S}, subject_key AS text, predicate AS entity_type, list(assertion_id ORDER BY event_id) AS ids, max(observed_at) AS observed_at
FROM {{event_assertions}} GROUP BY {S}, subject_key, predicate)
SELECT {S}, text, entity_type, {sql_id('entity-mention', sql_text('text'), sql_text('entity_type'),
id_part('ids'), SCOPE_JSON, sql_text(f'({ISO})'))} AS mention_id FROM g""",
)
def entity_mention_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = bind(spark, sf, "event_assertions").withColumn("text", F.col("subject_key"))
    made = made.withColumn("entity_type", F.col("predicate"))
    mentions = documents.entity_mentions(made)
    lists = id_lists(made, [*BY, "text", "entity_type"], ["event_id"], "assertion_id")
    joined = mentions.join(lists.withColumnRenamed("ids_json", "assertions_json"), [*BY, "text", "entity_type"])
    return with_record_id(joined, "entity-mention", "mention_id").select(*BY, "text", "entity_type", "mention_id")


@query(
    "observation_ids",
    f"""WITH {NORMALIZED}, v AS (SELECT *, CASE WHEN num IS NOT NULL THEN {sql_decimal('num')} WHEN date IS NOT NULL THEN CAST(date AS VARCHAR) ELSE text_value END AS value_text FROM obs)
SELECT record_key, field_name, {sql_id('normalized-observation', sql_text('record_key'), sql_text('record_key'), sql_text('field_name'),
"coalesce('" + chr(34) + "' || value_text || '" + chr(34) + "', 'null')", "coalesce('" + chr(34) + "' || unit || '" + chr(34) + "', 'null')", sql_text("record_key || '/' || field_name"),
"'" + chr(34) + "StateScope(tenant_id=''t'', project_id=''p'', site_id=''s'', version=''r1'')" + chr(34) + "'", "'" + chr(34) + "2024-01-20T00:00:00+00:00" + chr(34) + "'", sql_text('status'), "'" + chr(34) + "prov" + chr(34) + "'")} AS observation_id FROM v""",
)
def observation_ids(spark: SparkSession, sf: str) -> DataFrame:
    value = F.coalesce(decimal_text(F.col("num")), F.col("date").cast("string"), F.col("text_value"))
    columns = {
        "observation_key": F.col("record_key"),
        "subject_hint": F.col("record_key"),
        "predicate": F.col("field_name"),
        "value_text": value,
        "field_key": F.concat_ws("/", "record_key", "field_name"),
        "effective_at": cutoff(),
        "provenance_id": F.lit("prov"),
        **{name: F.lit(v) for name, v in zip(BY, ("t", "p", "s", "r1"))},
    }
    rows = observations(spark, sf).withColumns(columns)
    return with_record_id(rows, "normalized-observation", "observation_id").select(
        "record_key", "field_name", "observation_id"
    )


OBSERVED_SCOPE = "'" + chr(34) + "StateScope(tenant_id=''t'', project_id=''p'', site_id=''s'', version=''r1'')" + chr(34) + "'"
OBSERVED_ASSERTIONS = f"""{NORMALIZED}, said AS (SELECT *, CASE WHEN num IS NOT NULL THEN {sql_decimal('num')} WHEN date IS NOT NULL THEN CAST(date AS VARCHAR)
ELSE text_value END AS value_text, {sql_id('evidence', *[sql_text(c) for c in ("'lineitem'", "'hash-lineitem'", "'record'", "'lineitem'", "record_key || '/' || field_name")])} AS evidence_id
FROM obs WHERE status <> 'unresolved'),
assertions AS (SELECT record_key, field_name AS predicate, value_text, {sql_id('assertion', *[sql_text(c) for c in ("record_key", "field_name", "value_text", "evidence_id", "'document'")], "'null'")} AS assertion_id FROM said)"""
OBSERVED_MENTIONS = f"""{OBSERVED_ASSERTIONS}, naming AS (SELECT *, value_text AS text, 'return-flag' AS entity_type FROM assertions WHERE predicate = 'flag'),
lists AS (SELECT text, entity_type, list(assertion_id ORDER BY record_key, assertion_id) AS ids FROM naming GROUP BY text, entity_type),
mentions AS (SELECT text, entity_type, len(ids) AS assertion_count, {sql_id('entity-mention', sql_text('text'), sql_text('entity_type'), id_part('ids'),
OBSERVED_SCOPE, "'" + chr(34) + "2024-01-20T00:00:00+00:00" + chr(34) + "'")} AS mention_id FROM lists)"""


def asserted(spark: SparkSession, sf: str, observed: DataFrame | None = None) -> DataFrame:
    """Assertions of `observations`, or of those given, which were written already."""
    scope = {name: F.lit(v) for name, v in zip(BY, ("t", "p", "s", "r1"), strict=True)}
    seen = (observations(spark, sf) if observed is None else observed).withColumns({**scope, "observed_at": cutoff()})
    field_key = F.concat_ws("/", "record_key", "field_name")
    backing = record_evidence_id(F.lit("lineitem"), F.lit("hash-lineitem"), F.lit("lineitem"), field_key)
    return documents.assert_observations(seen, F.col("record_key"), backing)


def named_mentions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    naming = documents.naming_assertions(asserted(spark, sf), {"flag": "return-flag"})
    return naming, documents.identified_mentions(naming, ["record_key"])


@query("observation_assertions", f"WITH {OBSERVED_ASSERTIONS} SELECT record_key, predicate, value_text, assertion_id FROM assertions")
def observation_assertions(spark: SparkSession, sf: str) -> DataFrame:
    return asserted(spark, sf).select("record_key", "predicate", "value_text", "assertion_id")


@query("observation_mentions", f"WITH {OBSERVED_MENTIONS} SELECT text, entity_type, assertion_count, mention_id FROM mentions")
def observation_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return named_mentions(spark, sf)[1].select("text", "entity_type", "assertion_count", "mention_id")


@query(
    "observation_mention_links",
    f"WITH {OBSERVED_MENTIONS} SELECT assertion_id, mention_id FROM naming JOIN mentions USING (text, entity_type)",
)
def observation_mention_links(spark: SparkSession, sf: str) -> DataFrame:
    return documents.mention_links(*named_mentions(spark, sf)).select("assertion_id", "mention_id")


# ---- sources and exports --------------------------------------------------------------------

WORKBOOK_ROWS = 2000
BOOK_ORDER = ["line_no", "record_key", "quantity", "price"]


def sample_workbooks(spark: SparkSession, sf: str) -> DataFrame:
    """Workbooks of a fixed number of lines made from the whole line table, every fifth cut short.

    Every seventh has a quantity of thirteen digits, another seventh a price with seven decimals; the others write a quantity with an exponent.

    Lines are numbered first, so that no order, however large, makes a larger workbook.
    """
    lines = bind(spark, sf, "bom_lines").select(
        "line_no",
        "record_key",
        "sku",
        "description",
        F.col("quantity").cast("string").alias("quantity"),
        F.coalesce(F.col("unit_price").cast("string"), F.lit("")).alias("price"),
    )
    ship_package(spark)
    numbered = ledger.dense_sequence(lines, BOOK_ORDER)
    booked = numbered.withColumn("book", F.floor((F.col("sequence") - 1) / WORKBOOK_ROWS).cast("bigint"))

    def build(key, frame):
        ordered = frame.sort_values("sequence")
        rows = [workbooks.HEADER] + ordered[["sku", "description", "quantity", "price"]].values.tolist()
        rows[1][2] = {3: "1234567890123", 4: rows[1][2]}.get(key[0] % 7, f"{float(rows[1][2]) / 100:.8f}E2")
        rows[1][3] = "0.1234567" if key[0] % 7 == 4 else rows[1][3]
        content = workbooks.build_workbook(rows)
        if key[0] % 5 == 1:
            content = content[: len(content) // 2]
        return pd.DataFrame({"path": [f"book-{key[0]}.xlsx"], "content": [content]})

    return booked.groupBy("book").applyInPandas(build, "path string, content binary")


BOOKS = f"""n AS (SELECT *, row_number() OVER (ORDER BY line_no, record_key, CAST(quantity AS VARCHAR), coalesce(CAST(unit_price AS VARCHAR), '')) - 1 AS pos FROM {{bom_lines}}),
books AS (SELECT *, pos // {WORKBOOK_ROWS} AS book FROM n)"""


@query(
    "ingest_bom_xlsx",
    f"""WITH {BOOKS} SELECT 'book-' || book || '.xlsx' AS artifact_id, pos % {WORKBOOK_ROWS} + 2 AS line_no, sku, description,
CAST(quantity AS DECIMAL(38,6)) AS quantity, CAST(unit_price AS DECIMAL(38,6)) AS unit_price,
CASE WHEN unit_price IS NULL THEN 'A,B,C' ELSE 'A,B,C,D' END AS cells FROM books WHERE book % 5 <> 1 AND book % 7 NOT IN (3, 4)""",
)
def ingest_bom_xlsx(spark: SparkSession, sf: str) -> DataFrame:
    lines, _rejected = workbooks.read_workbooks(sample_workbooks(spark, sf))
    columns = ["artifact_id", "line_no", "sku", "description", "quantity", "unit_price"]
    return lines.select(*columns, F.array_join("cells", ",").alias("cells"))


@query(
    "rejected_workbooks",
    f"""WITH {BOOKS} SELECT DISTINCT 'book-' || book || '.xlsx' AS artifact_id, CASE WHEN book % 5 = 1 THEN 'BadZipFile' ELSE 'ValueError' END AS problem
FROM books WHERE book % 5 = 1 OR book % 7 IN (3, 4)""",
)
def rejected_workbooks(spark: SparkSession, sf: str) -> DataFrame:
    _lines, rejected = workbooks.read_workbooks(sample_workbooks(spark, sf))
    return rejected.select("artifact_id", F.substring_index("error", ":", 1).alias("problem"))


@query("workbook_events")
def workbook_events(spark: SparkSession, sf: str) -> DataFrame:
    return workbooks.structuring_events(sample_workbooks(spark, sf))


@query(
    "jsonl_items",
    "SELECT 'itm-' || p_partkey AS item_id, p_name AS description, p_brand || '|' || p_type AS aliases, 'each' AS unit FROM part",
)
def jsonl_items(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "items")
    made = table(spark, sf, "part").select(
        F.concat(F.lit("itm-"), F.col("p_partkey").cast("string")).alias("item_id"),
        F.col("p_name").alias("description"),
        F.array("p_brand", "p_type").alias("aliases"),
        F.lit("each").alias("unit"),
    )
    jsonl.write_json(made, path)
    return jsonl.read_source(spark, "items", path).withColumn("aliases", F.array_join("aliases", "|"))


@query(
    "jsonl_commitments",
    """SELECT line_id AS commitment_id, project_id, item_key AS item_id, 'vnd-' || l_suppkey AS vendor_id, CAST(quantity AS DECIMAL(38,6)) AS quantity,
CAST(order_date AS DATE) AS promised_date, 'confirmed' AS status, order_number AS source_id FROM {po_lines}""",
)
def jsonl_commitments(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "commitments")
    made = bind(spark, sf, "po_lines").select(
        F.col("line_id").alias("commitment_id"),
        "project_id",
        F.col("item_key").alias("item_id"),
        F.concat(F.lit("vnd-"), F.col("l_suppkey").cast("string")).alias("vendor_id"),
        F.col("quantity").cast("bigint").alias("quantity"),
        F.col("order_date").alias("promised_date"),
        F.lit("confirmed").alias("status"),
        F.col("order_number").alias("source_id"),
    )
    made.write.json(path)
    return jsonl.read_source(spark, "commitments", path)


@query(
    "export_reconciled_json",
    f"""WITH {reconciled('bom_lines')}, x AS (SELECT canonical_key, {sql_decimal('quantity')} AS q, {sql_decimal('unit_price')} AS p, governing_source_artifact AS g, status FROM rec)
SELECT '{{"canonical_key":"' || canonical_key || '","quantity":"' || q || '","unit_price":' || coalesce('"' || p || '"', 'null') || ',"governing_source_artifact":"' || g || '","status":"' || status || '"}}' AS json FROM x""".replace("{{\"", "{\"").replace("\"}}'", "\"}'"),
)
def export_reconciled_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = reconcile_lines(resolved_lines(spark, sf), PRECEDENCE)
    return jsonl.as_json(rows.select("canonical_key", "quantity", "unit_price", "governing_source_artifact", "status"))


@query(
    "export_claims_json",
    f"""WITH {claimed('small_boms')} SELECT '{{"project_id":"' || project_id || '","kind":"' || kind || '","value":' || coalesce('"' || {sql_decimal('value')} || '"', 'null') || ',"status":"' || status || '"}}' AS json FROM claims""".replace("{{\"", "{\"").replace("\"}}'", "\"}'"),
)
def export_claims_json(spark: SparkSession, sf: str) -> DataFrame:
    lines, candidates = bind(spark, sf, "small_boms"), bind(spark, sf, "candidates")
    made = bom_run.run_bom(lines, candidates, PRECEDENCE, keyword=KEYWORD).claims
    return jsonl.as_json(made.select("project_id", "kind", "value", "status"))


@query(
    "export_evidence_json",
    f"""SELECT '{{"artifact_id":"' || artifact_id || '","content_hash":"' || content_hash || '","location_kind":"record","evidence_id":"' || {EVIDENCE_SQL}
|| '","collection":"' || collection || '","record_key":"' || record_key || '"}}' AS json FROM {{bom_lines}}""",
)
def export_evidence_json(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "bom_lines")
    located = lines.withColumn("evidence_id", evidence_id(lines.columns))
    names = ["artifact_id", "content_hash", "location_kind", "evidence_id", "collection", "record_key"]
    return jsonl.as_json(located.select(*names))


NODE_JSON = " || ',' || ".join(
    f"""'{{"node_id":"' || node_{i} || '","kind":"{kind}","label":"{label}","status":"' || {status} || '"}}'"""
    for i, ((kind, label), status) in enumerate(zip(CHAIN_STEPS, ("'observed'", "s1", "s2", "run_status")))
)


@query(
    "export_chain_json",
    f"""WITH {RUN_SUMMARY},
ev AS (SELECT {S}, count(*) AS n, list(evidence_id ORDER BY line_no, evidence_id) AS ids
       FROM (SELECT *, {EVIDENCE_SQL} AS evidence_id FROM res) GROUP BY {S}),
parts AS (SELECT s.*, CASE WHEN unresolved_mentions = 0 THEN 'resolved' ELSE 'partially_resolved' END AS s1,
          CASE WHEN keys > 0 THEN 'observed' ELSE 'unresolved' END AS s2, {id_part('ids')} AS part
          FROM statuses s JOIN ev ON {on_scope('s', 'ev')}),
x AS (SELECT *, {NODE_JSON} AS listed FROM {chain_sql('parts', "'" + bom_run.RUN_CLAIM + "'", ["'observed'", 's1', 's2', 'run_status'], 'part')})
SELECT '{{"project_id":"' || project_id || '","chain_id":"' || chain_id || '","nodes":[' || listed || ']}}' AS json FROM x""",
)
def export_chain_json(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "small_boms")
    run = bom_run.run_bom(lines, bind(spark, sf, "candidates"), PRECEDENCE, keyword=KEYWORD, share=True)
    return jsonl.as_json(bom_run.run_chain(lines, run.summary).select("project_id", "chain_id", "nodes"))


# ---- streams --------------------------------------------------------------------------------


@query(
    "ledger_stream_ingest",
    "SELECT assertion_id, subject_key, predicate, value_text, observed_at, row_number() OVER (ORDER BY observed_at, assertion_id) AS sequence FROM {event_assertions}",
)
def ledger_stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    source, target, state_dir = (scratch_path(spark, n) for n in ("arrivals", "ledger", "offsets"))
    rows = bind(spark, sf, "event_assertions")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    streams.ingest_stream(stream, target, state_dir).awaitTermination()
    # the same files offered again under a new checkpoint add nothing
    again = spark.readStream.schema(rows.schema).parquet(source)
    streams.ingest_stream(again, target, state_dir + "-again").awaitTermination()
    columns = ["assertion_id", "subject_key", "predicate", "value_text", "observed_at", "sequence"]
    return streams.read_committed(spark, target).select(*columns)


@query(
    "ledger_late_batches",
    """SELECT assertion_id, observed_at, row_number() OVER (ORDER BY batch, observed_at, assertion_id) AS sequence
FROM (SELECT assertion_id, observed_at, min(event_id % 3) AS batch FROM {event_assertions} GROUP BY assertion_id, observed_at)""",
)
def ledger_late_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches over the same days, so that the later ones bring late rows; then two of them again."""
    target = scratch_path(spark, "ledger")
    rows = bind(spark, sf, "event_assertions")
    for batch in (0, 1, 2, 1, 0):
        streams.append_batch(rows.where(F.col("event_id") % 3 == batch), target, "events", batch)
    return streams.read_committed(spark, target).select("assertion_id", "observed_at", "sequence")


@query(
    "latest_observed_stream",
    f"""SELECT {S}, canonical_key, as_of, input_ordinal, freshness FROM (SELECT *, row_number() OVER (PARTITION BY {S}, canonical_key
ORDER BY as_of DESC, input_ordinal) AS place FROM {{observed}}) WHERE place = 1""",
)
def latest_observed_stream(spark: SparkSession, sf: str) -> DataFrame:
    source, target, state_dir = (scratch_path(spark, n) for n in ("observed", "latest", "state"))
    rows = bind(spark, sf, "observed")
    rows.repartition(4, "input_ordinal").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    streams.latest_stream(stream, target, state_dir).awaitTermination()
    streams.compact_latest(spark, target)
    latest = streams.read_latest(spark, target)
    return latest.select(*BY, "canonical_key", "as_of", "input_ordinal", "freshness")


"""Where results come from: events, assertions that name them, provenance of results, and origins of claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import bom, lineage, provenance
from ledgerline.operators.bom import BOM_KEY as BY
from ledgerline.operators.claims import BOM_COST, DISTINCT_SKUS, KEYWORD_QUANTITY
from ledgerline.plans import bom_run
from ledgerline.registry.base import S, query
from ledgerline.registry.bom import EVIDENCE_SQL, SAID, component_sql, reconciled, resolved, sql_id, sql_text
from ledgerline.session import materialize
from ledgerline.sources import workbooks
from ledgerline.sources.bindings import KEYWORD, PRECEDENCE, bind, table

SCHEMA = provenance.WORKBOOK_SCHEMA


def event_sql(content_hash: str, output: str) -> str:
    """Id of a structuring event in SQL."""
    used = sql_id(
        "run", *[f"'\"{v}\"'" if v else "'null'" for v in provenance.LOCAL_RUN.values()], f"'[\"artifact:' || {content_hash} || '\"]'"
    )
    parts = [*provenance.STRUCTURER, None, None, None, None, None, SCHEMA]
    made = sql_id("decision-provenance", sql_text(f"({used})"), *[f"'\"{v}\"'" if v else "'null'" for v in parts])
    inputs = f"""'[["used_input","artifact:' || {content_hash} || '"],["used_schema","schema:{SCHEMA}"]]'"""
    return sql_id("transformation-event", "'\"document-structuring\"'", sql_text(f"({made})"), inputs, f"""'["' || {output} || '"]'""", "'[]'")


@query(
    "document_events",
    f"""WITH h AS (SELECT 'doc://' || doc_id AS artifact_id, sha256(coalesce(text, '')) AS content_hash FROM documents),
o AS (SELECT *, 'structured-bom:' || content_hash || ':notes' AS output_id FROM h)
SELECT artifact_id, content_hash, output_id, {event_sql('content_hash', 'output_id')} AS transformation_event_id FROM o""",
)
def document_events(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("path"),
        F.coalesce("text", F.lit("")).cast("binary").alias("content"),
    )
    made = workbooks.structuring_events(files, sheet="notes")
    return made.select("artifact_id", "content_hash", "output_id", "transformation_event_id")


def bill_events(lines: DataFrame) -> DataFrame:
    return workbooks.events_of(lines.select("artifact_id", "content_hash").distinct())


@query(
    "event_assertion_ids",
    "WITH made AS (SELECT *, 'structured-bom:' || content_hash || ':BOM' AS output_id FROM {bom_lines}) "
    + " UNION ALL ".join(
        f"SELECT record_key, '{predicate}' AS predicate, "
        + sql_id(
            "assertion", sql_text("sku"), f"'\"{predicate}\"'", sql_text(value), sql_text(f"({EVIDENCE_SQL})"), "'\"document\"'",
            sql_text("(" + event_sql("content_hash", "output_id") + ")"),
        )
        + f" AS assertion_id FROM made WHERE {value} IS NOT NULL"
        for predicate, value in SAID.items()
    ),
)
def event_assertion_ids(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "bom_lines")
    # few rows once they are written, which the optimizer then knows
    named = workbooks.with_events(lines, materialize(bill_events(lines), "events"))
    made = bom.bom_assertions(named, F.col("transformation_event_id"), located=True)
    return bom.with_assertion_ids(made).select("record_key", "predicate", "assertion_id")


@query(
    "run_provenance",
    f"""WITH {reconciled('small_boms')},
decisions AS (SELECT DISTINCT {S}, sku FROM res)
SELECT 'decision' AS record, {S}, sku AS item, {component_sql(provenance.RESOLVER)} AS provenance_id FROM decisions
UNION ALL SELECT 'state', {S}, canonical_key, {component_sql(provenance.RECONCILER)} FROM rec
UNION ALL SELECT 'claim', {S}, unnest(['{DISTINCT_SKUS}', '{BOM_COST}', '{KEYWORD_QUANTITY}']), {component_sql(provenance.RECONCILER)}
FROM (SELECT DISTINCT {S} FROM res)""",
)
def run_provenance(spark: SparkSession, sf: str) -> DataFrame:
    lines, known = bind(spark, sf, "small_boms"), bind(spark, sf, "candidates")
    done = bom_run.with_provenance(bom_run.run_bom(lines, known, PRECEDENCE, keyword=KEYWORD, share=True))
    parts = [("decision", done.decisions, "mention"), ("state", done.reconciled_lines, "canonical_key"), ("claim", done.claims, "kind")]
    # one part after the other, so that the shuffle files of one lie on disk at a time
    first, *rest = [
        materialize(rows.select(F.lit(record).alias("record"), *BY, F.col(item).alias("item"), "provenance_id"), "provenance")
        for record, rows, item in parts
    ]
    for rows in rest:
        first = first.unionByName(rows)
    return first


CITED = "hit OR kind <> '" + KEYWORD_QUANTITY + "'"
CLAIM_NODE = "'[\"claim\",\"' || kind || '\",\"' || tenant_id || '\",\"' || project_id || '\",\"' || site_id || '\",\"' || version || '\"]'"


@query(
    "claim_origins",
    f"""WITH c AS (SELECT DISTINCT {S}, content_hash, contains(lower(description), '{KEYWORD}') AS hit,
unnest(['{DISTINCT_SKUS}', '{BOM_COST}', '{KEYWORD_QUANTITY}']) AS kind FROM {{small_boms}}),
used AS (SELECT *, {CLAIM_NODE} AS claim FROM c WHERE {CITED})
SELECT DISTINCT claim, 'artifact:' || content_hash AS origin FROM used UNION SELECT claim, 'schema:{SCHEMA}' FROM used""",
)
def claim_origins(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "small_boms")
    links = lineage.bom_edges(lines, bind(spark, sf, "candidates"), bill_events(lines), keyword=KEYWORD)
    found = lineage.origins(links)
    return found.where(F.col("node").startswith('["claim"')).select(F.col("node").alias("claim"), "origin")


@query(
    "lineage_edges",
    f"""WITH {resolved('small_boms')},
c AS (SELECT *, contains(lower(description), '{KEYWORD}') AS hit FROM res),
k AS (SELECT *, unnest(['{DISTINCT_SKUS}', '{BOM_COST}', '{KEYWORD_QUANTITY}']) AS kind FROM c),
e AS (SELECT DISTINCT {S}, kind, canonical_key, CASE WHEN canonical_key IS NULL THEN sku END AS open_sku FROM k WHERE {CITED}),
s AS (SELECT DISTINCT {S}, canonical_key, sku FROM c WHERE canonical_key IS NOT NULL),
d AS (SELECT DISTINCT {S}, sku, content_hash FROM c)
SELECT relation, count(*) AS edges FROM (
SELECT CASE WHEN canonical_key IS NULL THEN 'used_decision' ELSE 'used_state' END AS relation FROM e
UNION ALL SELECT 'used_decision' FROM s UNION ALL SELECT 'used_source' FROM d
UNION ALL SELECT unnest(['used_input', 'used_schema']) FROM (SELECT DISTINCT content_hash FROM c)) GROUP BY relation""",
)
def lineage_edges(spark: SparkSession, sf: str) -> DataFrame:
    lines = bind(spark, sf, "small_boms")
    links = lineage.bom_edges(lines, bind(spark, sf, "candidates"), bill_events(lines), keyword=KEYWORD)
    return links.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))

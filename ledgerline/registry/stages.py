"""One run through all stages that make rows here, counted while they run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators import documents, governed, provenance
from ledgerline.plans import bom_run
from ledgerline.plans.stage_trace import STAGES, ObservedRun
from ledgerline.registry import ledger, state
from ledgerline.registry.base import ORACLES, query
from ledgerline.sources.bindings import KEYWORD, PRECEDENCE, bind

# The query whose rows each stage makes. Nothing here predicts, decides or acts, so these stages show their empty results.
MADE_BY = {
    "INGEST": "capture_artifacts",
    "STRUCTURE": "structure_documents",
    "MAP": "map_fields",
    "NORMALIZE": "normalize_observations",
    "ASSERT": "observation_assertions",
    "RESOLVE": "resolve_identifiers",
    "RECONCILE": "reconcile",
    "DERIVE": "derived_fact_ids",
    "DETECT": "state_anomalies",
}


def _row(place: int, stage: str, empty: str) -> str:
    count = f"(SELECT count(*) FROM ({ORACLES[MADE_BY[stage]]}))" if stage in MADE_BY else "0"
    return f"SELECT {place} AS stage_index, '{stage}' AS stage, CAST({count} AS BIGINT) AS row_count, '{empty}' AS empty_result"


@query(
    "observed_stages",
    "SELECT stage_index, stage, row_count, CASE WHEN row_count > 0 THEN 'executed' ELSE empty_result END AS result FROM ("
    + " UNION ALL ".join(_row(place, *stage) for place, stage in enumerate(STAGES))
    + ")",
)
def observed_stages(spark: SparkSession, sf: str) -> DataFrame:
    run = ObservedRun()
    run.stage("INGEST", ledger.captured(spark, sf)[0])
    elements = run.stage("STRUCTURE", ledger.elements(spark, sf))
    mapping = spark.sql(f"SELECT * FROM {ledger.MAPPING} t(kind, field_name, mapping_schema)")
    run.stage("MAP", documents.map_fields(elements, mapping))
    observed = run.stage("NORMALIZE", ledger.observations(spark, sf))
    run.stage("ASSERT", ledger.asserted(spark, sf, observed))
    bill = bom_run.run_bom(bind(spark, sf, "bom_lines"), bind(spark, sf, "candidates"), PRECEDENCE, keyword=KEYWORD, share=True)
    run.stage("RESOLVE", bill.decisions)
    run.stage("RECONCILE", bill.reconciled_lines)
    facts = governed.outstanding_facts(state.identified(spark, sf, *state.shared_pairs(spark, sf)), state.made_by(provenance.DERIVER), state.UNIT)
    run.stage("DERIVE", facts)
    run.stage("DETECT", state.found(spark, sf))
    return run.trace(spark)

"""The evidence-first run over bill-of-materials lines, one lazy table per output."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.bom import KEYWORD, bom_assertions
from ledgerline.operators.claims import claims_from_summary, keys_of_totals, run_status, scope_summary, sku_totals
from ledgerline.operators.evidence import evidence_id, pipeline_statuses, with_chain
from ledgerline.operators import provenance
from ledgerline.operators.members import id_lists
from ledgerline.operators.reconciliation import merge_totals, only_single_source, reconcile_totals, single_source_totals
from ledgerline.operators.resolution import resolve_mentions, resolve_rows
from ledgerline.operators.scope import RequestContext, within
from ledgerline.schemas import SCOPE
from ledgerline.session import materialize

# Fixed value: the claim a run's own evidence chain stands for.
RUN_CLAIM = "BOM operational state"


@dataclass(frozen=True)
class BomRun:
    """Lazy outputs of a run; nothing is computed until a table is used."""

    assertions: DataFrame
    decisions: DataFrame
    operational_lines: DataFrame
    reconciled_lines: DataFrame
    summary: DataFrame
    claims: DataFrame


def run_bom(
    lines: DataFrame,
    candidates: DataFrame,
    precedence: Sequence[str] | None = None,
    by: Sequence[str] = SCOPE,
    keyword: str = KEYWORD,
    context: RequestContext | None = None,
    strict: bool = False,
    share: bool = False,
) -> BomRun:
    """Assertions, decisions, operational and reconciled lines, run summary and claims.

    Without a precedence the resolved lines of every scope must come from a single source; otherwise reconciled lines, summary and
    claims fail alike.

    Decisions, reconciled lines, summary and claims start from one table, lines combined per source and raw identifier. A run of which
    several outputs are used should share it: then it is written once, and the lines are read once for all of them. So are the combined
    lines with their decisions.
    """
    if context is not None:
        lines = within(lines, context)
    combined = sku_totals(lines, by, keyword)
    if share:
        combined = materialize(combined, "run")
    resolved = resolve_rows(combined, candidates)
    if share:
        resolved = materialize(resolved, "run")
    totals = merge_totals(resolved.where("resolution = 'resolved'"), [*by, "canonical_key", "artifact_id"])
    if precedence is None:
        reconciled = single_source_totals(totals, by, strict=True)
        keys = keys_of_totals(resolved.withColumn("artifact_id", F.lit("only")), ["only"], by)
        summary = only_single_source(scope_summary(keys, by), totals, by)
    else:
        rows = reconcile_totals(totals, precedence, by, strict=strict)
        reconciled = rows.where(F.col("governing_source_artifact").isNotNull())
        summary = scope_summary(keys_of_totals(resolved, precedence, by, strict), by)
    mentions = combined.groupBy(*by, F.col("sku").alias("mention")).agg(F.sum("line_count").alias("line_count"))
    return BomRun(
        assertions=bom_assertions(lines),
        decisions=resolve_mentions(mentions, candidates, by),
        operational_lines=resolve_rows(lines, candidates).where("resolution = 'resolved'"),
        reconciled_lines=reconciled,
        summary=summary.withColumn("run_status", run_status()),
        claims=claims_from_summary(summary, by),
    )


def with_provenance(run: BomRun, run_row: dict[str, Column] | None = None) -> BomRun:
    """The run with the `provenance_id` of the component that made each decision, reconciled line and claim; the local run unless another is given."""
    context = provenance.run_id(provenance.local_run() if run_row is None else run_row)
    resolver, reconciler = (provenance.component_provenance(context, c) for c in (provenance.RESOLVER, provenance.RECONCILER))
    return replace(
        run,
        decisions=run.decisions.withColumn("provenance_id", resolver),
        reconciled_lines=run.reconciled_lines.withColumn("provenance_id", reconciler),
        claims=run.claims.withColumn("provenance_id", reconciler),
    )


def run_chain(lines: DataFrame, summary: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Evidence chain of each scope's run, over all its lines. The summary is written before the evidence is dealt out."""
    summary = materialize(summary, "run")
    located = lines.select(*by, "line_no", evidence_id(lines.columns).alias("evidence_id"))
    lists = id_lists(located, by, ["line_no"])
    rows = summary.join(lists, list(by))
    statuses = pipeline_statuses(F.col("lines"), F.col("unresolved"), F.col("keys"), F.col("run_status"))
    return with_chain(rows, F.lit(RUN_CLAIM), statuses)


__all__ = ["BomRun", "RUN_CLAIM", "run_bom", "run_chain", "with_provenance"]

"""Planner-facing reports composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.claims import sku_totals
from ledgerline.operators.reconciliation import merge_totals, reconcile_totals
from ledgerline.operators.resolution import resolve_rows
from ledgerline.schemas import MONEY, SCOPE, TOTAL_PRICE, TOTAL_QUANTITY
from ledgerline.session import materialize


def sku_worklist(
    lines: DataFrame, candidates: DataFrame, precedence: Sequence[str], by: Sequence[str] = SCOPE
) -> DataFrame:
    """Canonical items with required quantity and number of spellings, then mentions left for review.

    Lines are read once; what all parts start from is written to the shared folder.
    """
    resolved = materialize(resolve_rows(materialize(sku_totals(lines, by), "worklist"), candidates), "worklist")
    settled = resolved.where("resolution = 'resolved'")
    spellings = (
        settled.select(*by, "canonical_key", "sku")
        .distinct()
        .groupBy(*by, "canonical_key")
        .agg(F.count(F.lit(1)).alias("mentions"))
    )
    items = (
        reconcile_totals(merge_totals(settled, [*by, "canonical_key", "artifact_id"]), precedence, by)
        .where(F.col("governing_source_artifact").isNotNull())
        .join(spellings, [*by, "canonical_key"])
        .select(
            *by,
            F.lit("item").alias("section"),
            F.col("canonical_key").alias("item"),
            F.col("quantity").cast("decimal(38,6)").alias("required_quantity"),
            "mentions",
            F.col("status").alias("note"),
        )
    )
    review = (
        resolved.where("resolution = 'unresolved'")
        .groupBy(*by, "sku", "rationale")
        .agg(F.sum("quantity").cast("decimal(38,6)").alias("required_quantity"))
        .select(
            *by,
            F.lit("review").alias("section"),
            F.col("sku").alias("item"),
            "required_quantity",
            F.lit(1).cast("bigint").alias("mentions"),
            F.col("rationale").alias("note"),
        )
    )
    return items.unionByName(review)


def aliases(
    lines: DataFrame, candidates: DataFrame, by: Sequence[str] = SCOPE
) -> DataFrame:
    """Spellings that resolved to each item, one per row."""
    mentions = lines.groupBy(*by, "sku").agg(F.count(F.lit(1)).alias("line_count"))
    return resolve_rows(mentions, candidates).where("resolution = 'resolved'").select(
        *by, "canonical_key", F.col("sku").alias("alias"), "line_count"
    )


def latest_prices(prices: DataFrame, cutoff: Column, by: Sequence[str] = ()) -> DataFrame:
    """Newest price per item at or before the cutoff; on equal times the lowest wins."""
    newest = Window.partitionBy(*by, "canonical_key").orderBy(F.desc("effective_at"), F.asc("unit_price"))
    return (
        prices.where(F.col("effective_at") <= cutoff)
        .withColumn("_n", F.row_number().over(newest))
        .where("_n = 1")
        .select(*by, "canonical_key", "unit_price", "effective_at")
    )


def scenario_lines(
    proposed: DataFrame, candidates: DataFrame, prices: DataFrame, cutoff: Column, by: Sequence[str] = SCOPE
) -> DataFrame:
    """Proposed lines, summed per spelling, with the price in force; none is invented.

    proposed: by, sku, quantity.
    """
    summed = proposed.groupBy(*by, "sku").agg(F.sum("quantity").cast(TOTAL_QUANTITY).alias("quantity"))
    resolved = resolve_rows(summed, candidates)
    scoped = [name for name in by if name in prices.columns]  # a price table with scope columns prices its own scopes only
    priced = resolved.join(
        latest_prices(prices, cutoff, scoped).select(
            *scoped, "canonical_key", F.col("unit_price").cast(TOTAL_PRICE).alias("unit_price"), "effective_at"
        ),
        [*scoped, "canonical_key"],
        "left",
    )
    section = (
        F.when(F.col("resolution") == "unresolved", "unresolved")
        .when(F.col("unit_price").isNull(), "missing_price")
        .otherwise("priced")
    )
    return priced.select(
        *by,
        "sku",
        "canonical_key",
        "quantity",
        "unit_price",
        "effective_at",
        section.alias("section"),
        (F.col("quantity") * F.col("unit_price")).cast(MONEY).alias("extension"),
    )


def scenario_cost(lines: DataFrame, current: DataFrame | None = None, by: Sequence[str] = SCOPE) -> DataFrame:
    """Total per scenario, null while anything is unpriced or unresolved; optional comparison.

    current: by, cost (the reconciled bill's cost, possibly null).
    """
    total = lines.groupBy(*by).agg(
        F.count(F.when(F.col("section") == "priced", 1)).alias("priced_lines"),
        F.count(F.when(F.col("section") == "missing_price", 1)).alias("missing_price_lines"),
        F.count(F.when(F.col("section") == "unresolved", 1)).alias("unresolved_lines"),
        F.sum("extension").cast(MONEY).alias("priced_subtotal"),
    )
    complete = (F.col("missing_price_lines") == 0) & (F.col("unresolved_lines") == 0)
    costed = total.withColumn("total", F.when(complete, F.col("priced_subtotal"))).withColumn(
        "status", F.when(complete, "inferred").otherwise("unresolved")
    )
    if current is None:
        return costed
    return (
        costed.join(current.select(*by, F.col("cost").alias("current_cost")), list(by), "left")
        .withColumn("difference", (F.col("total") - F.col("current_cost")).cast(MONEY))
    )


def commitment_delays(commitments: DataFrame, events: DataFrame, tolerance_days: int = 0) -> DataFrame:
    """Promised against last observed date per commitment.

    commitments: commitment_id, promised_date. events: commitment_id, observed_date.
    """
    seen = events.groupBy("commitment_id").agg(
        F.max("observed_date").alias("observed_date"), F.count(F.lit(1)).alias("event_count")
    )
    joined = commitments.join(seen, "commitment_id", "left")
    late = F.col("observed_date") > F.date_add("promised_date", tolerance_days)
    return joined.select(
        *commitments.columns,
        "observed_date",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.date_diff("observed_date", "promised_date").cast("bigint").alias("days_late"),
        F.when(F.col("observed_date").isNull(), "open").when(late, "late").otherwise("on_time").alias("delay_status"),
    )


def alias_candidates(items: DataFrame, key: str, names: Sequence[str] = (), aliases: str = "aliases") -> DataFrame:
    """Candidate surface forms of canonical records: the key, other names and every alias."""
    own = F.array(F.col(key), *[F.col(n) for n in names])
    forms = F.array_distinct(F.concat(own, F.coalesce(F.col(aliases), F.array().cast("array<string>"))))
    return items.select(F.col(key).alias("canonical_key"), F.explode(forms).alias("candidate")).where(
        F.col("candidate").isNotNull()
    )

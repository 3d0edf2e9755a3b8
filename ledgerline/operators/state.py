"""Operational lines, expected requirements and observed state as of a point in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import Json, decimal_text, json_text, scope_text, stable_id
from ledgerline.operators.resolution import last_decisions
from ledgerline.schemas import SCOPE, TOTAL_QUANTITY


def operational_lines(lines: DataFrame, decisions: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Lines whose raw identifier equals a resolved mention, under the canonical key."""
    if "ordinal" in decisions.columns:
        decisions = last_decisions(decisions, by)
    resolved = decisions.where("status = 'resolved'").select(*by, F.col("mention").alias("sku"), "canonical_key")
    return lines.join(resolved, [*by, "sku"])


def expected_requirements(lines: DataFrame, as_of: Column, by: Sequence[str] = SCOPE) -> DataFrame:
    """Required quantity per key, summed over all its operational lines."""
    return (
        lines.groupBy(*by, "canonical_key")
        .agg(
            F.sum("quantity").cast(TOTAL_QUANTITY).alias("required_quantity"),
            F.count(F.lit(1)).alias("evidence_count"),
        )
        .withColumn("as_of", as_of)
    )


def latest_observed(
    observed: DataFrame, as_of: Column, by: Sequence[str] = SCOPE, ordinal: str = "input_ordinal"
) -> DataFrame:
    """Newest observation per key at or before the cutoff; on equal times the earliest input row.

    A rank filter of one lets Spark keep a single candidate per key and task before the shuffle.
    """
    window = Window.partitionBy(*by, "canonical_key").orderBy(F.desc("as_of"), F.asc(ordinal))
    return (
        observed.where(F.col("as_of") <= as_of)
        .withColumn("_n", F.row_number().over(window))
        .where("_n = 1")
        .drop("_n")
    )


def compare_expected_observed(
    expected: DataFrame,
    observed: DataFrame,
    as_of: Column,
    by: Sequence[str] = SCOPE,
    ordinal: str = "input_ordinal",
) -> DataFrame:
    """Pair requirements with the latest observation of the same scope and key.

    Requirements newer than the cutoff vanish; unmatched ones stay, with unknown freshness.
    """
    latest = latest_observed(observed, as_of, by, ordinal).select(
        *by,
        "canonical_key",
        F.lit(True).alias("observed"),
        F.col("as_of").alias("observed_as_of"),
        *[F.col(name).cast(TOTAL_QUANTITY).alias(name) for name in OBSERVED_QUANTITIES],
        F.col("freshness").alias("_freshness"),
        F.col(ordinal).alias("observed_ordinal"),
    )
    required = expected.where(F.col("as_of") <= as_of)
    paired = required.join(latest, [*by, "canonical_key"], "left")
    return paired.select(
        "*",
        outstanding_quantity().alias("outstanding_quantity"),
        F.coalesce("_freshness", F.lit("unknown")).alias("freshness"),
    ).drop("_freshness")


OBSERVED_QUANTITIES = (
    "ordered_quantity",
    "received_quantity",
    "substituted_quantity",
    "delayed_quantity",
    "unknown_quantity",
)


def outstanding_quantity() -> Column:
    received = F.coalesce(F.col("received_quantity"), F.lit(0).cast(TOTAL_QUANTITY))
    return F.greatest(F.col("required_quantity") - received, F.lit(0)).cast("decimal(38,6)")


STATE_ATTRIBUTES = ("required_quantity", *OBSERVED_QUANTITIES)


def state_attributes(pairs: DataFrame, by: Sequence[str] = SCOPE, unit: str | None = None) -> DataFrame:
    """One row per state attribute, all in the same unit; a missing value is unresolved."""
    attributes = F.array(
        *[
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("name"),
                F.col(name).cast("decimal(38,6)").alias("value"),
            )
            for position, name in enumerate(STATE_ATTRIBUTES)
        ]
    )
    rows = pairs.select(*by, "canonical_key", "as_of", "freshness", F.inline(attributes))
    status = F.when(F.col("value").isNull(), "unresolved").otherwise("observed")
    return rows.withColumn("status", status).withColumn("unit", F.lit(unit).cast("string"))


def operational_state(attributes: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Attribute rows rolled up to one state per subject.

    Attribute names are unique within a subject, so the array is as long as the attribute
    vocabulary, not as the data.
    """
    entry = F.struct("position", "name", "value", "status", "unit")
    return (
        attributes.groupBy(*by, "canonical_key", "as_of", "freshness")
        .agg(
            F.sort_array(F.collect_list(entry)).alias("attributes"),
            F.count(F.when(F.col("status") == "unresolved", 1)).alias("unresolved_count"),
        )
        .withColumn("subject_key", subject_key())
    )


def subject_key(key: Column | None = None) -> Column:
    """tenant/project/site/version:key"""
    path = F.concat_ws("/", *[F.col(name) for name in SCOPE])
    return F.concat(path, F.lit(":"), F.col("canonical_key") if key is None else key)


def state_ids(states: DataFrame, as_of_text: Column, provenance_id: Column) -> DataFrame:
    """State identifier over attribute names, values and statuses; needs `ids_json`."""
    triple = F.transform(
        F.col("attributes"),
        lambda a: F.concat(
            F.lit("["),
            F.concat_ws(",", json_text(a["name"]), json_text(decimal_text(a["value"])), json_text(a["status"])),
            F.lit("]"),
        ),
    )
    listed = F.concat(F.lit("["), F.array_join(triple, ","), F.lit("]"))
    return states.withColumn(
        "state_id",
        stable_id(
            "operational-state",
            F.col("subject_key"),
            scope_text(),
            as_of_text,
            F.col("freshness"),
            Json(listed),
            Json(F.col("ids_json")),
            provenance_id,
            F.lit(None).cast("string"),
        ),
    )


def derived_facts(pairs: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Facts inferred from state: outstanding quantity per subject."""
    return pairs.select(
        *by,
        subject_key().alias("subject_key"),
        F.lit("outstanding_quantity").alias("predicate"),
        F.col("outstanding_quantity").alias("value"),
        "as_of",
        F.lit("inferred").alias("status"),
    )


def input_bundles(
    items: DataFrame, cutoff: Column, by: Sequence[str] = SCOPE, time: str = "as_of", id_col: str = "item_id"
) -> DataFrame:
    """Members of the decision or prediction input of each scope at a cutoff, newer ones left out.

    Membership stays a table; `members.id_lists` turns it into the id part of the bundle.
    """
    return items.where(F.col(time) <= cutoff).select(*by, cutoff.alias("bundle_as_of"), id_col).distinct()


def requirement_breakdown(pairs: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Required, ordered, received and outstanding quantity per model; models are never merged."""
    zero = F.lit(0)
    return pairs.select(
        *by,
        "canonical_key",
        F.col("required_quantity").cast("decimal(38,6)").alias("required_quantity"),
        F.coalesce("ordered_quantity", zero).cast("decimal(38,6)").alias("ordered_quantity"),
        F.coalesce("received_quantity", zero).cast("decimal(38,6)").alias("received_quantity"),
        F.coalesce("substituted_quantity", zero).cast("decimal(38,6)").alias("substituted_quantity"),
        "outstanding_quantity",
        "freshness",
    )

"""Reconciliation of resolved lines from several sources under an explicit precedence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import errors
from ledgerline.errors import ContractError
from ledgerline.schemas import SCOPE, TOTAL_PRICE, TOTAL_QUANTITY


def checked_precedence(precedence: Sequence[str]) -> tuple[str, ...]:
    names = tuple(precedence)
    if not names:
        raise ContractError("a precedence policy needs at least one source")
    if len(set(names)) != len(names):
        raise ContractError("a precedence policy lists every source once")
    return names


def source_rank(precedence: Sequence[str], source: Column) -> Column:
    """One-based rank in the policy; null for a source the policy does not name."""
    position = F.array_position(F.array(*[F.lit(name) for name in checked_precedence(precedence)]), source)
    return F.when(position > 0, position.cast("int"))


def source_totals(
    lines: DataFrame, by: Sequence[str] = SCOPE, key: str = "canonical_key", source: str = "artifact_id"
) -> DataFrame:
    """Per key and source: quantity, extreme prices, lines without price, line count.

    Extremes and counts say whether the prices have one distinct value (null is a value too), with
    constant state per group instead of a set.
    """
    return lines.groupBy(*by, key, source).agg(
        F.sum("quantity").alias("quantity"),
        F.min("unit_price").alias("min_price"),
        F.max("unit_price").alias("max_price"),
        F.count(F.when(F.col("unit_price").isNull(), 1)).alias("unpriced"),
        F.count(F.lit(1)).alias("line_count"),
    )


def merge_totals(totals: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Combine source totals to coarser keys."""
    return totals.groupBy(*keys).agg(
        F.sum("quantity").alias("quantity"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.sum("unpriced").alias("unpriced"),
        F.sum("line_count").alias("line_count"),
        *extra,
    )


def _one_price() -> Column:
    unpriced = F.col("unpriced")
    return (unpriced == F.col("line_count")) | ((unpriced == 0) & (F.col("min_price") == F.col("max_price")))


def reconcile_totals(
    totals: DataFrame,
    precedence: Sequence[str],
    by: Sequence[str] = SCOPE,
    source: str = "artifact_id",
    strict: bool = False,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key from per-source totals.

    Conflict when the governing source has more than one distinct price, or when any other source
    differs in quantity or single price. "All sources agree" is decided by extremes over the
    sources. Keys no listed source covers are left to `uncovered_keys`, or fail the job if strict.
    """
    price = F.when(_one_price() & (F.col("unpriced") == 0), F.col("min_price"))
    signed = totals.select(
        "*",
        _one_price().alias("_one"),
        price.alias("_price"),
        F.col("quantity").cast(TOTAL_QUANTITY).alias("_quantity"),
        source_rank(precedence, F.col(source)).alias("_rank"),
    )
    governing = F.min(
        F.when(F.col("_rank").isNotNull(), F.struct("_rank", "_quantity", "_price", "_one", "line_count", source))
    )
    grouped = signed.groupBy(*by, "canonical_key").agg(
        governing.alias("_g"),
        (F.min("_quantity") == F.max("_quantity")).alias("_same_quantity"),
        (
            (F.count("_price") == 0)
            | ((F.count("_price") == F.count(F.lit(1))) & (F.min("_price") == F.max("_price")))
        ).alias("_same_price"),
        F.count(F.lit(1)).alias("source_count"),
        F.sum("line_count").alias("_lines"),
        *extra,
    )
    governor = F.col(f"_g.{source}")
    if strict:
        # part of the result column, so that no filter can be evaluated ahead of it
        failure = F.raise_error(F.lit(errors.NO_GOVERNING_SOURCE)).cast("string")
        governor = F.when(F.col("canonical_key").isNotNull() & F.col("_g").isNull(), failure).otherwise(governor)
    agree = F.col("_g._one") & F.col("_same_quantity") & F.col("_same_price")
    named_extra = [c for c in grouped.columns if c not in (*by, "canonical_key", "source_count") and c[0] != "_"]
    return grouped.select(
        *by,
        "canonical_key",
        F.col("_g._quantity").alias("quantity"),
        F.col("_g._price").cast(TOTAL_PRICE).alias("unit_price"),
        governor.alias("governing_source_artifact"),
        "source_count",
        F.col("_g.line_count").alias("evidence_count"),
        (F.col("_lines") - F.col("_g.line_count")).alias("losing_evidence_count"),
        F.when(agree, "reconciled").otherwise("conflict").alias("status"),
        *named_extra,
    )


def reconcile_lines(
    lines: DataFrame, precedence: Sequence[str], by: Sequence[str] = SCOPE, strict: bool = False
) -> DataFrame:
    """Reconcile operational lines; see `reconcile_totals` for the rules."""
    rows = reconcile_totals(source_totals(lines, by), precedence, by, strict=strict)
    return rows.where(F.col("governing_source_artifact").isNotNull())


def uncovered_keys(lines: DataFrame, precedence: Sequence[str], by: Sequence[str] = SCOPE) -> DataFrame:
    """Keys none of whose sources the policy names."""
    ranked = lines.withColumn("_rank", source_rank(precedence, F.col("artifact_id")))
    return (
        ranked.groupBy(*by, "canonical_key")
        .agg(F.count("_rank").alias("_covered"), F.count(F.lit(1)).alias("line_count"))
        .where("_covered = 0")
        .select(
            *by,
            "canonical_key",
            "line_count",
            F.lit(errors.NO_GOVERNING_SOURCE).alias("error_code"),
            F.lit(errors.category_of(errors.NO_GOVERNING_SOURCE)).alias("category"),
        )
    )


def sources_without_policy(lines: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Scopes with several sources: without a policy they cannot be reconciled."""
    sources = lines.select(*by, "artifact_id").distinct()
    return sources.groupBy(*by).agg(F.count(F.lit(1)).alias("source_count")).where("source_count > 1")


def only_single_source(rows: DataFrame, lines: DataFrame, by: Sequence[str] = SCOPE, strict: bool = True) -> DataFrame:
    """`rows` of scopes whose `lines` have one source; others fail the job, or drop out when not strict."""
    several = sources_without_policy(lines, by).select(*by, F.lit(True).alias("_several"))
    marked = rows.join(several, list(by), "left")
    if strict:
        alone = F.when(F.col("_several"), F.raise_error(F.lit(errors.NO_GOVERNING_SOURCE))).otherwise(F.lit(True))
        return marked.where(alone.cast("boolean")).drop("_several")
    return marked.where(F.col("_several").isNull()).drop("_several")


def reconcile_single_source(lines: DataFrame, by: Sequence[str] = SCOPE, strict: bool = True) -> DataFrame:
    """Reconciliation without a policy: each scope's only source governs.

    Scopes with several sources fail the job, or drop out when not strict.
    """
    return single_source_totals(source_totals(lines, by), by, strict)


def single_source_totals(totals: DataFrame, by: Sequence[str] = SCOPE, strict: bool = True) -> DataFrame:
    """`reconcile_single_source` from totals per key and source."""
    marked = only_single_source(totals, totals, by, strict)
    one = marked.withColumn("_only", F.lit("only"))
    rows = reconcile_totals(one, ["only"], by, source="_only")
    names = marked.groupBy(*by).agg(F.min("artifact_id").alias("_source"))
    return (
        rows.join(names, list(by))
        .withColumn("governing_source_artifact", F.col("_source"))
        .drop("_source")
    )


def reconciled_sources(
    lines: DataFrame, precedence: Sequence[str], by: Sequence[str] = SCOPE
) -> DataFrame:
    """Source list of every key as rows, each marked governing or losing."""
    totals = source_totals(lines, by)
    governing = reconcile_totals(totals, precedence, by).select(
        *by, "canonical_key", "governing_source_artifact"
    )
    role = F.when(F.col("artifact_id") == F.col("governing_source_artifact"), "governing").otherwise("losing")
    return (
        totals.join(governing, [*by, "canonical_key"])
        .where(F.col("governing_source_artifact").isNotNull())
        .select(*by, "canonical_key", "artifact_id", role.alias("role"), "line_count")
    )


def reconciled_evidence(
    lines: DataFrame, reconciled: DataFrame, by: Sequence[str] = SCOPE
) -> DataFrame:
    """Every line's evidence under its reconciled key, marked governing or losing."""
    chosen = reconciled.select(*by, "canonical_key", "governing_source_artifact")
    role = F.when(F.col("artifact_id") == F.col("governing_source_artifact"), "governing").otherwise("losing")
    return lines.join(chosen, [*by, "canonical_key"]).withColumn("role", role)


def governing_sources(observations: DataFrame, precedence: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """First listed source that is present, per key; null where none is."""
    names = F.array(*[F.lit(name) for name in checked_precedence(precedence)])
    best = observations.groupBy(*keys).agg(F.min(source_rank(precedence, F.col("artifact_id"))).alias("_rank"))
    return best.select(*keys, F.try_element_at(names, F.col("_rank")).alias("governing_source"))

"""Purchase orders against bills of quantities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import Json, decimal_text, json_ids, stable_id
from ledgerline.schemas import MONEY, SCOPE, TOTAL_QUANTITY


def line_total() -> Column:
    return (F.col("quantity") * F.col("unit_price")).cast(MONEY)


def order_totals(lines: DataFrame, keys: Sequence[str] = (*SCOPE, "order_number")) -> DataFrame:
    """Exact total per order."""
    return lines.groupBy(*keys).agg(
        F.sum(line_total()).cast(MONEY).alias("total"), F.count(F.lit(1)).alias("line_count")
    )


def boq_coverage(boq_lines: DataFrame, po_lines: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Ordered against required quantity per bill line; order lines are summed before they meet it."""
    ordered = (
        po_lines.where(F.col("boq_id").isNotNull())
        .groupBy(*by, "boq_id", F.col("boq_line_id").alias("line_id"))
        .agg(F.sum("quantity").cast(TOTAL_QUANTITY).alias("ordered_quantity"), F.count(F.lit(1)).alias("po_lines"))
    )
    zero = F.lit(0).cast(TOTAL_QUANTITY)
    joined = boq_lines.join(ordered, [*by, "boq_id", "line_id"], "left")
    covered = F.coalesce("ordered_quantity", zero)
    return joined.select(
        *by,
        "boq_id",
        "line_id",
        "item_key",
        F.col("quantity").cast("decimal(38,6)").alias("required_quantity"),
        covered.cast("decimal(38,6)").alias("ordered_quantity"),
        F.greatest(F.col("quantity") - covered, zero).cast("decimal(38,6)").alias("uncovered_quantity"),
        F.coalesce("po_lines", F.lit(0)).alias("po_lines"),
        F.when(F.col("po_lines").isNull(), "unordered")
        .when(covered < F.col("quantity"), "partial")
        .otherwise("covered")
        .alias("coverage"),
    )


def order_references(boq_lines: DataFrame, po_lines: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Both sides of orders and bills, one row per reference: what was required and ordered, and how the two are `linked`.

    `linked`: the bill has the line; `unordered`: no order refers to it; `dangling`: no bill has it; `scope_mismatch`: only a bill of another
    scope has it; `unreferenced`: the order lines of a scope that name no bill, summed in one row. Order lines are summed before they meet bills.
    """
    keys = [*by, "boq_id", "line_id"]
    ordered = po_lines.groupBy(*by, "boq_id", F.col("boq_line_id").alias("line_id")).agg(
        F.sum("quantity").cast(TOTAL_QUANTITY).alias("ordered_quantity"), F.count(F.lit(1)).alias("po_lines")
    )
    free = ordered.where("boq_id IS NULL").groupBy(*by).agg(
        F.sum("ordered_quantity").cast(TOTAL_QUANTITY).alias("ordered_quantity"), F.sum("po_lines").alias("po_lines")
    )
    required = boq_lines.groupBy(*keys).agg(F.sum("quantity").cast(TOTAL_QUANTITY).alias("required_quantity"))
    met = required.join(ordered.where("boq_id IS NOT NULL"), keys, "full")
    known = boq_lines.select("boq_id", "line_id").distinct().withColumn("elsewhere", F.lit(True))
    told = met.join(known, ["boq_id", "line_id"], "left").withColumn(
        "linked",
        F.when(F.col("po_lines").isNull(), "unordered")
        .when(F.col("required_quantity").isNotNull(), "linked")
        .when(F.col("elsewhere"), "scope_mismatch")
        .otherwise("dangling"),
    )
    none = F.lit(None)
    free = free.select(
        *by, none.cast("string").alias("boq_id"), none.cast("string").alias("line_id"), F.lit("unreferenced").alias("linked"),
        none.cast(TOTAL_QUANTITY).alias("required_quantity"), "ordered_quantity", "po_lines",
    )
    columns = [*keys, "linked", "required_quantity", "ordered_quantity", "po_lines"]
    return told.select(*columns).unionByName(free.select(*columns)).fillna(0, subset=["po_lines"])


def boq_line_id() -> Column:
    return stable_id(
        "boq-line",
        F.col("line_id"),
        F.col("item_key"),
        decimal_text(F.col("quantity")),
        F.col("unit"),
        F.col("evidence_id"),
    )


def purchase_order_line_id() -> Column:
    return stable_id(
        "purchase-order-line",
        F.col("line_id"),
        F.col("item_key"),
        decimal_text(F.col("quantity")),
        F.col("unit"),
        decimal_text(F.col("unit_price")),
        F.col("currency"),
        F.date_format("required_by", "yyyy-MM-dd"),
        F.col("evidence_id"),
        F.col("boq_id"),
        F.col("boq_line_id"),
    )


def purchase_order_id(line_ids: Column) -> Column:
    """Order identifier over its ordered line ids; issue time and status do not enter."""
    scope = [F.col(name) for name in SCOPE]
    return stable_id(
        "purchase-order",
        F.col("order_number"),
        F.col("supplier_key"),
        *scope,
        Json(json_ids(line_ids)),
        F.col("evidence_id"),
    )


def boq_document_id(line_ids: Column) -> Column:
    """Bill identifier over its ordered line ids; as_of does not enter."""
    return stable_id(
        "boq",
        F.col("boq_number"),
        F.col("revision"),
        F.col("tenant_id"),
        F.col("project_id"),
        F.col("site_id"),
        F.col("evidence_id"),
        Json(json_ids(line_ids)),
    )

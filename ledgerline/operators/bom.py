"""Bill-of-materials lines: assertions and the three raw questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import casefold, decimal_text, stable_id
from ledgerline.operators.evidence import evidence_id
from ledgerline.schemas import MONEY, SCOPE

BOM_KEY = SCOPE

# Fixed value: the accelerator keyword questions use unless another is given.
KEYWORD = "gpu"


def has_keyword(description: Column, keyword: str = KEYWORD) -> Column:
    return casefold(description).contains(keyword)


def usable(lines: DataFrame) -> DataFrame:
    """Lines whose own status is not unresolved."""
    return lines.where(F.col("status") != "unresolved") if "status" in lines.columns else lines


def bom_assertions(lines: DataFrame, event_id: Column | None = None, located: bool = False) -> DataFrame:
    """Three or four assertions per line; a missing price asserts nothing.

    `ordinal` keeps the emission order inside a line. Identifiers are added by
    `with_assertion_ids`, so that jobs which do not need them never hash. If located, the evidence
    of a line is hashed once for all its assertions, as `_evidence_id`.
    """
    if located:
        lines = lines.withColumn("_evidence_id", evidence_id(lines.columns))

    def claim(ordinal: int, predicate: str, kind: str, text: Column, number: Column | None = None) -> Column:
        return F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.lit(predicate).alias("predicate"),
            F.lit(kind).alias("value_type"),
            text.alias("value_text"),
            (F.lit(None) if number is None else number).cast("decimal(18,6)").alias("value_num"),
        )

    quantity, price = F.col("quantity"), F.col("unit_price")
    claims = F.array(
        claim(0, "has_sku", "text", F.col("sku")),
        claim(1, "has_description", "text", F.col("description")),
        claim(2, "has_quantity", "decimal", decimal_text(quantity), quantity),
        F.when(price.isNotNull(), claim(3, "has_unit_price", "decimal", decimal_text(price), price)),
    )
    event = F.lit(None).cast("string") if event_id is None else event_id
    return lines.select(
        *[c for c in lines.columns if c != "transformation_event_id"],
        F.col("sku").alias("subject_key"),
        F.lit("document").alias("source_system"),
        event.alias("transformation_event_id"),
        F.inline(F.filter(claims, lambda c: c.isNotNull())),
    )


def identifier_assertions(lines: DataFrame) -> DataFrame:
    """Only the has_sku assertions, one per line, without making the others first."""
    return lines.select(
        *lines.columns,
        F.col("sku").alias("subject_key"),
        F.lit("document").alias("source_system"),
        F.lit(None).cast("string").alias("transformation_event_id"),
        F.lit("has_sku").alias("predicate"),
        F.col("sku").alias("value_text"),
    )


def with_assertion_ids(assertions: DataFrame) -> DataFrame:
    known = "_evidence_id" in assertions.columns
    located = assertions.withColumn("evidence_id", F.col("_evidence_id") if known else evidence_id(assertions.columns))
    return located.drop("_evidence_id").withColumn("assertion_id", assertion_id())


def assertion_id() -> Column:
    names = ("subject_key", "predicate", "value_text", "evidence_id", "source_system", "transformation_event_id")
    return stable_id("assertion", *[F.col(name) for name in names])


def distinct_skus(lines: DataFrame, by: Sequence[str] = BOM_KEY) -> DataFrame:
    """Distinct raw identifiers with the number of lines behind each: one row per identifier.

    The list of one large bill would not fit one row, so it stays a table.
    """
    return (
        usable(lines)
        .groupBy(*by, "sku")
        .agg(F.count(F.lit(1)).alias("evidence_count"))
        .withColumn("status", F.lit("observed"))
    )


def _counts(lines: DataFrame) -> Column:
    """Whether a line counts for the raw questions; a bill of other lines only still gets its zero."""
    return F.col("status") != "unresolved" if "status" in lines.columns else F.lit(True)


def keyword_quantity(lines: DataFrame, by: Sequence[str] = BOM_KEY, keyword: str = KEYWORD) -> DataFrame:
    """Quantity over lines whose description holds the keyword; zero where none does."""
    hit = _counts(lines) & has_keyword(F.col("description"), keyword)
    return (
        lines.groupBy(*by)
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("quantity"))), F.lit(0)).cast("decimal(38,6)").alias("value"),
            F.count(F.when(hit, 1)).alias("evidence_count"),
        )
        .withColumn("status", F.lit("observed"))
    )


def bom_cost(lines: DataFrame, by: Sequence[str] = BOM_KEY) -> DataFrame:
    """Exact cost; one missing price leaves the whole bill unresolved."""
    counts = _counts(lines)
    missing = F.count(F.when(counts & F.col("unit_price").isNull(), 1))
    total = F.coalesce(F.sum(F.when(counts, F.col("quantity") * F.col("unit_price"))), F.lit(0)).cast(MONEY)
    return (
        lines.groupBy(*by)
        .agg(missing.alias("_missing"), total.alias("_total"), F.count(F.when(counts, 1)).alias("evidence_count"))
        .select(
            *by,
            F.when(F.col("_missing") == 0, F.col("_total")).alias("value"),
            F.when(F.col("_missing") == 0, "observed").otherwise("unresolved").alias("status"),
            "evidence_count",
        )
    )

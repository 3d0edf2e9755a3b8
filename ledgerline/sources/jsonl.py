"""JSON-lines sources with declared schemas, and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import schemas
from ledgerline.functions import decimal_text

SOURCES = {
    "items": schemas.ITEMS,
    "vendors": schemas.VENDORS,
    "commitments": schemas.COMMITMENTS,
    "events": schemas.COMMITMENT_EVENTS,
}


def read_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Items, vendors, commitments or events; nothing is inferred."""
    return spark.read.schema(SOURCES[name]).json(path)


def _public(df: DataFrame) -> list[Column]:
    """Columns for public JSON: decimals as plain text."""
    return [
        decimal_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ]


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON document per row; null fields stay visible."""
    return df.select(F.to_json(F.struct(*_public(df)), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    """JSON-lines export of claims, reconciled state, evidence chains or review contexts."""
    df.select(*_public(df)).write.option("ignoreNullFields", "false").json(path)

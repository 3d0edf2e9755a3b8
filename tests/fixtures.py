"""Small hand-made tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ledgerline.schemas import BOM_LINES

SCOPE_VALUES = {"tenant_id": "tenant", "project_id": "project", "site_id": "site", "version": "bom-v1"}


def expected_id(namespace: str, *parts: object) -> str:
    text = json.dumps([namespace, *parts], ensure_ascii=True, separators=(",", ":"))
    return f"{namespace}:{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def day(n: int, month: int = 1) -> dt.datetime:
    return dt.datetime(2026, month, n)


def bom(spark: SparkSession, rows: list[tuple], artifact: str = "bom.xlsx", **scope: str) -> DataFrame:
    """Lines from (sku, description, quantity, price[, artifact])."""
    made = []
    for i, (sku, description, quantity, price, *source) in enumerate(rows):
        made.append(
            {
                **SCOPE_VALUES,
                **scope,
                "artifact_id": source[0] if source else artifact,
                "content_hash": "hash",
                "line_no": i + 2,
                "sku": sku,
                "description": description,
                "quantity": Decimal(str(quantity)),
                "unit_price": None if price is None else Decimal(str(price)),
                "status": "observed",
                "location_kind": "tabular",
                "sheet": "BOM",
                "row": i + 2,
                "cells": ["A", "B", "C", "D"],
                "collection": None,
                "record_key": None,
            }
        )
    return spark.createDataFrame(made, BOM_LINES)


def candidates(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "candidate string")


def operational(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Operational lines from (canonical_key, quantity, unit_price, artifact)."""
    scope = tuple(SCOPE_VALUES.values())
    made = [
        (*scope, key, Decimal(str(q)), None if p is None else Decimal(str(p)), a) for key, q, p, a in rows
    ]
    return spark.createDataFrame(
        made,
        "tenant_id string, project_id string, site_id string, version string, canonical_key string, "
        "quantity decimal(18,6), unit_price decimal(18,6), artifact_id string",
    )

"""Explicit schemas of the durable tables, and the shared column groups."""

from __future__ import annotations

from pyspark.sql import types as T

# A scope is four plain columns so that it can be a partition, join or grouping key.
SCOPE = ("tenant_id", "project_id", "site_id", "version")

QUANTITY = T.DecimalType(18, 6)
# sum(quantity) narrowed so that quantity x price still fits 38 digits with all 12 decimals.
TOTAL_QUANTITY = T.DecimalType(20, 6)
TOTAL_PRICE = T.DecimalType(17, 6)
MONEY = T.DecimalType(38, 12)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_SCOPE_FIELDS = {name: T.StringType() for name in SCOPE}

BOM_LINES = _struct(
    **_SCOPE_FIELDS,
    artifact_id=T.StringType(),
    content_hash=T.StringType(),
    line_no=T.LongType(),
    sku=T.StringType(),
    description=T.StringType(),
    quantity=QUANTITY,
    unit_price=QUANTITY,
    status=T.StringType(),
    location_kind=T.StringType(),
    sheet=T.StringType(),
    row=T.LongType(),
    cells=T.ArrayType(T.StringType()),
    collection=T.StringType(),
    record_key=T.StringType(),
)

WORKBOOK_LINES = _struct(
    artifact_id=T.StringType(),
    content_hash=T.StringType(),
    line_no=T.LongType(),
    sku=T.StringType(),
    description=T.StringType(),
    quantity_text=T.StringType(),
    unit_price_text=T.StringType(),
    sheet=T.StringType(),
    row=T.LongType(),
    cells=T.ArrayType(T.StringType()),
    error=T.StringType(),
)

LEDGER = _struct(
    sequence=T.LongType(),
    assertion_id=T.StringType(),
    subject_key=T.StringType(),
    predicate=T.StringType(),
    value_text=T.StringType(),
    observed_at=T.TimestampType(),
)

ITEMS = _struct(
    item_id=T.StringType(),
    description=T.StringType(),
    aliases=T.ArrayType(T.StringType()),
    unit=T.StringType(),
)
VENDORS = _struct(
    vendor_id=T.StringType(),
    name=T.StringType(),
    aliases=T.ArrayType(T.StringType()),
    region=T.StringType(),
)
COMMITMENTS = _struct(
    commitment_id=T.StringType(),
    project_id=T.StringType(),
    item_id=T.StringType(),
    vendor_id=T.StringType(),
    quantity=QUANTITY,
    promised_date=T.DateType(),
    status=T.StringType(),
    source_id=T.StringType(),
)
COMMITMENT_EVENTS = _struct(
    event_id=T.StringType(),
    commitment_id=T.StringType(),
    event_type=T.StringType(),
    observed_date=T.DateType(),
    status=T.StringType(),
    source_id=T.StringType(),
)

"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.sources.bindings import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# scope columns as a SQL list
S = "tenant_id, project_id, site_id, version"


def on_scope(left: str, right: str) -> str:
    """Equality of two scopes in SQL."""
    return " AND ".join(f"{left}.{c} = {right}.{c}" for c in S.split(", "))


def normalized(value: str) -> str:
    """Normalized identifier in SQL, for the ASCII test data."""
    return f"regexp_replace(lower({value}), '[^a-z0-9]', '', 'g')"


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its check unless SQL cannot express it."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(run(spark, sf_dir))
        if check is not None:
            ORACLES[name] = oracle(check)
        return run

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Common output types: two decimal widths, instants as zone-free UTC timestamps."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast(T.DecimalType(38, 12 if field.dataType.scale > 6 else 6))
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)

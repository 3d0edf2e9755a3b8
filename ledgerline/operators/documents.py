"""From captured artifacts to typed observations and mentions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import Json, decimal_text, has_exact_place, instant_text, is_blank, scope_text, stable_id
from ledgerline.operators.bom import assertion_id
from ledgerline.operators.evidence import record_evidence_id
from ledgerline.operators.members import id_lists
from ledgerline.operators.record_ids import with_record_id
from ledgerline.schemas import SCOPE


def capture(references: DataFrame, contents: DataFrame, provenance_id: Column) -> tuple[DataFrame, DataFrame]:
    """Join source references to captured contents; returns (artifacts, rejected captures).

    references: source_system, source_uri, scope columns, observed_at, source_version.
    contents: source_uri, content_hash, media_type, byte_length, captured_at.
    A capture before its observation is rejected, and so is a reference without a timed capture; rejection says which.
    """
    joined = references.join(contents, "source_uri", "left").withColumn(
        "reference_id",
        stable_id(
            "source-reference",
            F.col("source_system"),
            F.col("source_uri"),
            scope_text(),
            instant_text(F.col("observed_at")),
            F.col("source_version"),
        ),
    )
    in_time = F.col("captured_at") >= F.col("observed_at")
    artifacts = joined.where(in_time).withColumn(
        "artifact_id",
        stable_id(
            "artifact",
            F.col("reference_id"),
            F.col("content_hash"),
            F.col("media_type"),
            Json(F.col("byte_length").cast("string")),
            instant_text(F.col("captured_at")),
            provenance_id,
        ),
    )
    reason = F.when(F.col("captured_at").isNull(), "not captured").otherwise("captured before it was observed")
    return artifacts, joined.where(~F.coalesce(in_time, F.lit(False))).withColumn("rejection", reason)


def structure(documents: DataFrame, collection: str, kind: Column, text: str = "text") -> DataFrame:
    """Split each whole text into ordered elements, one per line.

    documents: artifact_id, content_hash and a text column. `kind` may use `ordinal`.
    """
    lines = documents.select(
        *[c for c in documents.columns if c != text],
        F.posexplode(F.split(text, "\n")).alias("ordinal", "text"),
    )
    element = F.concat_ws("#", "artifact_id", F.col("ordinal").cast("string"))
    return lines.withColumn("element_id", element).withColumn("kind", kind).withColumn("collection", F.lit(collection))


def element_evidence_id() -> Column:
    return record_evidence_id(
        F.col("artifact_id"), F.col("content_hash"), F.col("collection"), F.col("element_id")
    )


def map_fields(elements: DataFrame, mapping: DataFrame) -> DataFrame:
    """Give elements field names by their kind; an empty element stays, unresolved and explained.

    mapping: kind, field_name, mapping_schema. Its size is the schema's, and the optimizer sees it.
    """
    missing = is_blank(F.col("text"))
    return elements.join(mapping, "kind").select(
        *elements.columns,
        "field_name",
        "mapping_schema",
        F.concat_ws("/", "element_id", "field_name").alias("field_key"),
        F.when(~missing, F.col("text")).alias("raw_value"),
        F.when(missing, "unresolved").otherwise("observed").alias("status"),
        F.when(missing, "source element is empty").alias("diagnostic"),
    )


def normalize(fields: DataFrame, types: DataFrame) -> DataFrame:
    """Typed, unit-bearing values from raw fields, by declared type.

    types: field_name, value_type (decimal, date, timestamp, text), unit, factor. Values that do not
    parse, numbers that have no exact place in DECIMAL(18,6) and fields that are not declared become unresolved
    observations with a diagnostic; nothing is dropped or rounded.
    """
    joined = fields.join(types, "field_name", "left")
    raw, kind = F.col("raw_value"), F.col("value_type")
    exact = F.when(kind == "decimal", has_exact_place(raw))
    number = F.when(exact, F.expr("try_cast(raw_value as decimal(18,6))")) * F.coalesce(F.col("factor"), F.lit(1))
    typed = joined.select(
        *[c for c in joined.columns if c not in ("status", "diagnostic", "factor")],
        F.when(kind == "decimal", number.cast("decimal(38,12)")).alias("num"),
        F.when(kind == "date", F.expr("try_cast(raw_value as date)")).alias("date"),
        F.when(kind == "timestamp", F.expr("try_cast(raw_value as timestamp)")).alias("ts"),
        F.when(kind == "text", raw).alias("text_value"),
        (~exact).alias("_inexact"),
    )
    empty = F.coalesce(
        F.col("num").cast("string"), F.col("date").cast("string"), F.col("ts").cast("string"), F.col("text_value")
    ).isNull()
    return typed.select(
        "*",
        F.when(empty, "unresolved").otherwise("observed").alias("status"),
        F.when(F.col("raw_value").isNull(), "source field is missing")
        .when(kind.isNull(), "field is not declared")
        .when(F.col("_inexact"), "number has no exact place in 18 digits with 6 decimals")
        .when(empty, "value does not parse as declared")
        .alias("diagnostic"),
    ).drop("_inexact")


def observation_assertions(observations: DataFrame) -> DataFrame:
    """Assertions of the resolved observations; unresolved ones assert nothing."""
    return observations.where("status <> 'unresolved'")


def assert_observations(
    observations: DataFrame,
    subject: Column,
    evidence_id: Column,
    event_id: Column | None = None,
    source_system: str = "document",
) -> DataFrame:
    """Assertions made from typed observations: subject, predicate, typed value and its text, evidence, `assertion_id`.

    Identifiers follow the rule of workbook lines, so an observation and a line that say the same from the same evidence are the
    same assertion. Unresolved observations assert nothing. Times enter in UTC with their offset, as other instants do.
    """
    value = F.coalesce(decimal_text(F.col("num")), F.col("date").cast("string"), instant_text(F.col("ts")), F.col("text_value"))
    made = {
        "subject_key": subject,
        "predicate": F.col("field_name"),
        "value_text": value,
        "evidence_id": evidence_id,
        "source_system": F.lit(source_system),
        "transformation_event_id": F.lit(None).cast("string") if event_id is None else event_id,
    }
    return observation_assertions(observations).withColumns(made).withColumn("assertion_id", assertion_id())


def naming_assertions(assertions: DataFrame, entities: Mapping[str, str]) -> DataFrame:
    """The assertions whose value names an entity, with `text` and `entity_type`; entities gives the type for each such predicate."""
    kinds = [F.when(F.col("predicate") == predicate, F.lit(kind)) for predicate, kind in entities.items()]
    kind = reduce(lambda a, b: F.coalesce(a, b), kinds, F.lit(None).cast("string"))
    named = assertions.withColumn("text", F.col("value_text")).withColumn("entity_type", kind)
    return named.where(F.col("entity_type").isNotNull() & ~is_blank(F.col("text")))


def identified_mentions(naming: DataFrame, order: Sequence[str], by: Sequence[str] = SCOPE) -> DataFrame:
    """Mentions of naming assertions with `mention_id` over their assertions in the given order."""
    keys = [*by, "text", "entity_type"]
    lists = id_lists(naming, keys, order, "assertion_id").select(*keys, F.col("ids_json").alias("assertions_json"))
    mentions = entity_mentions(naming, text="text", by=by)
    return with_record_id(mentions.join(lists, keys), "entity-mention", "mention_id").drop("assertions_json")


def mention_links(naming: DataFrame, mentions: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Which mention each naming assertion belongs to: one row per assertion."""
    keys = [*by, "text", "entity_type"]
    return naming.select(*keys, "assertion_id").join(mentions.select(*keys, "mention_id"), keys)


def entity_mentions(
    assertions: DataFrame, text: str = "subject_key", entity_type: str = "entity_type", by: Sequence[str] = SCOPE
) -> DataFrame:
    """One mention per surface form, type and scope, with its number of assertions.

    The assertions themselves stay linked by those keys, since one form may hold most of a table.
    """
    return assertions.groupBy(*by, F.col(text).alias("text"), F.col(entity_type).alias("entity_type")).agg(
        F.count(F.lit(1)).alias("assertion_count"), F.max("observed_at").alias("observed_at")
    )

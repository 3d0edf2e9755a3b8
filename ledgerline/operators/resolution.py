"""Conservative identifier resolution: one exact normalized match, or none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import Json, normalize_identifier, stable_id
from ledgerline.schemas import SCOPE

# Rationales that enter decision identifiers.
MATCHED = "normalized exact identifier match"
MISSING = "no normalized candidate match"
AMBIGUOUS = "ambiguous normalized candidate match"


def candidate_index(candidates: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Candidates per normalized form. A candidate listed twice counts twice."""
    return (
        candidates.withColumn("identifier_key", normalize_identifier(F.col("candidate")))
        .groupBy(*scope, "identifier_key")
        .agg(F.count(F.lit(1)).alias("candidate_count"), F.min("candidate").alias("only_candidate"))
    )


def _verdict(rows: DataFrame) -> DataFrame:
    single = F.col("candidate_count") == 1
    return rows.select(
        *[c for c in rows.columns if c not in ("candidate_count", "only_candidate")],
        F.when(single, F.col("only_candidate")).alias("canonical_key"),
        F.when(single, "resolved").otherwise("unresolved").alias("resolution"),
        F.when(single, MATCHED)
        .when(F.col("candidate_count") > 1, AMBIGUOUS)
        .otherwise(MISSING)
        .alias("rationale"),
    )


def resolve_rows(
    rows: DataFrame, candidates: DataFrame, mention: str = "sku", scope: Sequence[str] = ()
) -> DataFrame:
    """Attach identifier_key, canonical_key, resolution and rationale to every row.

    A decision is a function of the mention alone, so this one join stands for resolving the
    distinct mentions and joining them back. The join type is left to the optimizer: adaptive
    execution broadcasts a small catalogue and splits skewed partitions of a large one.
    """
    keyed = rows.withColumn("identifier_key", normalize_identifier(F.col(mention)))
    return _verdict(keyed.join(candidate_index(candidates, scope), [*scope, "identifier_key"], "left"))


def resolve_identifiers(
    lines: DataFrame,
    candidates: DataFrame,
    by: Sequence[str] = SCOPE,
    candidate_scope: Sequence[str] = (),
) -> DataFrame:
    """One decision per (scope, mention), with the number of identifier assertions behind it.

    Supporting assertions are those of the same scope and normalized form. They are counted
    here; their table is `resolution_evidence`.
    """
    mentions = lines.groupBy(*by, F.col("sku").alias("mention")).agg(F.count(F.lit(1)).alias("line_count"))
    return resolve_mentions(mentions, candidates, by, candidate_scope)


def resolve_mentions(
    mentions: DataFrame, candidates: DataFrame, by: Sequence[str] = SCOPE, candidate_scope: Sequence[str] = ()
) -> DataFrame:
    """`resolve_identifiers` from mentions that are combined already: by, mention, line_count."""
    keyed = mentions.withColumn("identifier_key", normalize_identifier(F.col("mention")))
    support = keyed.groupBy(*by, "identifier_key").agg(F.sum("line_count").alias("evidence_count"))
    joined = keyed.join(support, [*by, "identifier_key"])
    decided = _verdict(
        joined.join(candidate_index(candidates, candidate_scope), [*candidate_scope, "identifier_key"], "left")
    )
    return decided.withColumnRenamed("resolution", "status")


def resolution_evidence(assertions: DataFrame) -> DataFrame:
    """Identifier assertions keyed by normalized subject: the evidence of every decision on that key."""
    return assertions.where(F.col("predicate") == "has_sku").withColumn(
        "identifier_key", normalize_identifier(F.col("subject_key"))
    )


def decision_ids(decisions: DataFrame, provenance_id: Column) -> DataFrame:
    """Decision identifier; needs the assertion list of the key as `ids_json`."""
    return decisions.withColumn(
        "decision_id",
        stable_id(
            "resolution-decision",
            F.col("mention"),
            F.col("canonical_key"),
            F.col("status"),
            Json(F.coalesce(F.col("ids_json"), F.lit("[]"))),
            F.col("rationale"),
            provenance_id,
        ),
    )


def last_decisions(decisions: DataFrame, by: Sequence[str] = SCOPE, ordinal: str = "ordinal") -> DataFrame:
    """The last decision per mention wins."""
    window = Window.partitionBy(*by, "mention").orderBy(F.desc(ordinal))
    return decisions.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def canonicalized_assertions(
    assertions: DataFrame, decisions: DataFrame, by: Sequence[str] = SCOPE
) -> DataFrame:
    """Assertions linked to the resolved decision on their own subject.

    The raw subject is matched, so an assertion meets one decision and not every spelling of its
    key. Unresolved subjects drop out. The `decision_id` of identified decisions comes along.
    """
    named = [c for c in ("decision_id",) if c in decisions.columns]
    resolved = decisions.where("status = 'resolved'").select(
        *by, F.col("mention").alias("subject_key"), "canonical_key", "identifier_key", *named
    )
    return assertions.join(resolved, [*by, "subject_key"])

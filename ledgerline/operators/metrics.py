"""Offline quality: resolution, retrieval, anomalies and extraction against gold tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def resolution_metrics(decisions: DataFrame, gold: DataFrame, by: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Precision, recall, false merges and the review class of resolution decisions.

    gold: join columns, grouping columns and gold_key (null when the mention has no canonical item). Gold mentions without a
    decision count against recall.
    """
    judged = decisions.withColumn("_decided", F.lit(1)).join(gold, list(on), "right")
    resolved = F.col("canonical_key").isNotNull()
    right = resolved & (F.col("canonical_key") == F.col("gold_key"))
    counts = judged.groupBy(*by).agg(
        F.count("_decided").alias("mentions"),
        F.count(F.when(resolved, 1)).alias("resolved"),
        F.count(F.when(right, 1)).alias("correct"),
        F.count(F.when(resolved & ~F.coalesce(right, F.lit(False)), 1)).alias("false_merges"),
        F.count(F.when(F.col("rationale").startswith("ambiguous"), 1)).alias("review"),
        F.count("gold_key").alias("gold"),
    )
    return counts.select(
        "*",
        _ratio(F.col("correct"), F.col("resolved")).alias("precision"),
        _ratio(F.col("correct"), F.col("gold")).alias("recall"),
        _ratio(F.col("false_merges"), F.col("resolved")).alias("false_merge_rate"),
    )


def retrieval_metrics(hits: DataFrame, judgements: DataFrame, k: int) -> DataFrame:
    """Recall@k and nDCG@k per query for binary judgements.

    hits: query_id, entry_id, rank. judgements: query_id, entry_id (relevant pairs).
    """
    relevant = judgements.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    found = (
        hits.where(F.col("rank") <= k)
        .join(judgements, ["query_id", "entry_id"])
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("found"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    )
    best = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")),
        F.lit(0.0),
        lambda total, rank: total + 1 / F.log2(rank + 1),
    )
    return relevant.join(found, "query_id", "left").select(
        "query_id",
        "relevant",
        F.coalesce("found", F.lit(0)).alias("found"),
        _ratio(F.coalesce("found", F.lit(0)), F.col("relevant")).alias("recall"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / best, 9).alias("ndcg"),
    )


def precision_at_budget(
    alerts: DataFrame, labels: DataFrame, budget: int, by: Sequence[str], order: Sequence[Column], on: Sequence[str]
) -> DataFrame:
    """Share of true alerts among the first `budget` of each group; labels: join columns, is_true."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    top = alerts.withColumn("_place", place).where(F.col("_place") <= budget)
    judged = top.join(labels, list(on), "left")
    return (
        judged.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("alerts"), F.count(F.when(F.col("is_true"), 1)).alias("true_alerts"))
        .withColumn("precision", _ratio(F.col("true_alerts"), F.col("alerts")))
    )


def extraction_metrics(fields: DataFrame, gold: DataFrame, by: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Field precision, recall and abstention; fields and gold carry `value` and `gold_value` text."""
    joined = fields.join(gold, list(on), "full")
    given = F.col("value").isNotNull()
    right = given & (F.col("value") == F.col("gold_value"))
    counts = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fields"),
        F.count(F.when(given, 1)).alias("extracted"),
        F.count("gold_value").alias("gold"),
        F.count(F.when(right, 1)).alias("correct"),
        F.count(F.when(~given, 1)).alias("abstained"),
    )
    return counts.select(
        "*",
        _ratio(F.col("correct"), F.col("extracted")).alias("precision"),
        _ratio(F.col("correct"), F.col("gold")).alias("recall"),
        _ratio(F.col("abstained"), F.col("fields")).alias("abstention_rate"),
    )

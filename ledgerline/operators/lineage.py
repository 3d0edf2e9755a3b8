"""What results were made from: edges between records, and the walk from each record to its origins.

An edge (node, relation, target) says that `node` was made with `target`. Nodes are unambiguous texts: identifiers, or keys as JSON arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.errors import ContractError
from ledgerline.operators.bom import KEYWORD, has_keyword
from ledgerline.operators.claims import BOM_COST, DISTINCT_SKUS, KEYWORD_QUANTITY
from ledgerline.operators.resolution import resolve_rows
from ledgerline.schemas import SCOPE
from ledgerline.session import discard, materialize


def node(kind: str, *parts: str) -> Column:
    """The node of a record by its kind and key columns."""
    return F.to_json(F.array(F.lit(kind), *[F.col(part).cast("string") for part in parts]))


def edges(rows: DataFrame, made: Column, relation: str, target: Column) -> DataFrame:
    return rows.select(made.alias("node"), F.lit(relation).alias("relation"), target.alias("target")).distinct()


def event_edges(events: DataFrame) -> DataFrame:
    """Edges of structuring events: what came out, from which artifact, under which schema."""
    return edges(events, F.col("output_id"), "used_input", F.col("snapshot_id")).unionByName(
        edges(events, F.col("output_id"), "used_schema", F.col("schema_id"))
    )


def bom_edges(
    lines: DataFrame, candidates: DataFrame, events: DataFrame, by: Sequence[str] = SCOPE, keyword: str = KEYWORD
) -> DataFrame:
    """Edges of a bill-of-materials run: claims rest on states and open decisions, states on decisions, decisions on structured sources.

    Lines are combined to (scope, identifier, source, keyword or not) before any edge is made, so the edges grow with the distinct
    mentions and not with the lines. events: as `structuring_events` makes them, by artifact_id and content_hash.
    """
    hit = has_keyword(F.col("description"), keyword)
    cited = lines.select(*by, "sku", "artifact_id", "content_hash", hit.alias("hit")).distinct()
    combined = materialize(resolve_rows(cited, candidates), "lineage")
    resolved = F.col("canonical_key").isNotNull()
    decision, state = node("decision", *by, "sku"), node("state", *by, "canonical_key")
    kinds = F.array(F.lit(DISTINCT_SKUS), F.lit(BOM_COST), F.when(F.col("hit"), F.lit(KEYWORD_QUANTITY)))
    claimed = combined.withColumn("kind", F.explode(F.array_compact(kinds)))
    claim = node("claim", "kind", *by)
    outputs = events.select("artifact_id", "content_hash", "output_id")
    return reduce(
        DataFrame.unionByName,
        [
            edges(claimed.where(resolved), claim, "used_state", state),
            edges(claimed.where(~resolved), claim, "used_decision", decision),
            edges(combined.where(resolved), state, "used_decision", decision),
            edges(combined.join(outputs, ["artifact_id", "content_hash"]), decision, "used_source", F.col("output_id")),
            event_edges(events),
        ],
    )


def origins(links: DataFrame) -> DataFrame:
    """(node, origin): every origin that a node was made from, over any number of steps. An origin is a target that was made from nothing.

    All nodes step at once, and in each round a step becomes twice as long: a target that is no origin yet gives way to what it leads
    to itself, so paths of n edges take log2(n) rounds. Each round is one join over distinct pairs, is written once and replaces the one before. Repeated edges,
    self-loops and edges with a null end add nothing; a longer cycle fails the job, since it has no origin. No edges give no rows.
    """
    known = materialize(links.select("node", "target").where("node <> target").distinct(), "lineage")
    made = known.select(F.col("node").alias("target"), F.lit(True).alias("_made")).distinct()
    walks = materialize(
        known.join(made, "target", "left").select("node", "target", F.coalesce("_made", F.lit(False)).alias("further")), "lineage"
    )
    length, nodes = 1, None
    while True:
        open_walks = walks.where("further")
        if open_walks.isEmpty():
            return walks.select("node", F.col("target").alias("origin"))
        if nodes is None:
            nodes = made.count()
            discard(known)
        if length > nodes:
            raise ContractError("records cannot be made from each other")
        on = walks.select(F.col("node").alias("_middle"), F.col("target").alias("_next"), F.col("further").alias("_further"))
        longer = open_walks.join(on, F.col("target") == F.col("_middle")).select(
            "node", F.col("_next").alias("target"), F.col("_further").alias("further")
        )
        before, walks = walks, materialize(walks.where("NOT further").unionByName(longer).distinct(), "lineage")
        discard(before)
        length *= 2

"""Operational states, derived facts and input bundles with their identifiers.

Each level names the members of the one below: a state its evidence, a fact its evidence and states, a bundle its facts, anomalies,
predictions, evidence or states. Lists of any length enter identifiers through `members.id_lists`; `uncontained` finds members that the
level above misses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import decimal_text, instant_text, json_ids
from ledgerline.operators.members import id_lists
from ledgerline.operators.record_ids import with_record_id
from ledgerline.operators.state import OBSERVED_QUANTITIES, operational_state, state_ids
from ledgerline.schemas import SCOPE
from ledgerline.session import materialize

# The lists of each input bundle, in order.
BUNDLES = {
    "decision-input": ("facts", "anomalies", "predictions"),
    "prediction-input": ("evidence", "states"),
}


def attribute_evidence(attributes: DataFrame, evidence: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """How many evidence rows each state attribute rests on.

    evidence: scope, canonical_key, evidence_id, side (0 requirement, 1 observation), as `anomalies.state_evidence` makes it. Quantities
    of an observation rest on it; the requirement, and what was not observed, on the requirement. Rows are counted per side before they
    meet the attributes, so evidence is never copied once per attribute.
    """
    counted = evidence.groupBy(*by, "canonical_key").agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("_required"), F.count(F.when(F.col("side") == 1, 1)).alias("_observed")
    )
    seen = F.col("name").isin(*OBSERVED_QUANTITIES) & (F.col("_observed") > 0)
    return attributes.join(counted, [*by, "canonical_key"]).select(
        *by, "canonical_key", "name", "value", "unit", "status", F.when(seen, F.col("_observed")).otherwise(F.col("_required")).alias("evidence_count")
    )


def identified_states(
    attributes: DataFrame, evidence: DataFrame, provenance_id: Column, by: Sequence[str] = SCOPE
) -> DataFrame:
    """One row per state: attributes with unit, `evidence_count`, `ids_json` (its evidence) and `state_id`.

    A state without evidence has no row here; `uncontained(attributes, states, keys)` shows it.
    """
    keys = [*by, "canonical_key"]
    lists = id_lists(evidence, keys, ["side"]).select(*keys, F.col("id_count").alias("evidence_count"), "ids_json")
    rolled = operational_state(attributes, by).join(lists, keys)
    return state_ids(rolled, instant_text(F.col("as_of")), provenance_id)


def _attribute(name: str) -> Column:
    """Value of an attribute; names are unique within a state."""
    return F.filter("attributes", lambda a: a["name"] == name)[0]["value"]


def outstanding_facts(states: DataFrame, provenance_id: Column, unit: str, by: Sequence[str] = SCOPE) -> DataFrame:
    """The outstanding quantity of each state as an inferred fact, with its state, evidence and `fact_id`."""
    zero = F.lit(0).cast("decimal(38,6)")
    left = F.greatest(_attribute("required_quantity") - F.coalesce(_attribute("received_quantity"), zero), zero)
    facts = states.select(
        *by,
        "canonical_key",
        "subject_key",
        F.lit("outstanding_quantity").alias("predicate"),
        left.cast("decimal(38,6)").alias("value"),
        "as_of",
        F.lit("inferred").alias("status"),
        F.lit(unit).alias("unit"),
        "state_id",
        "evidence_count",
        F.col("ids_json").alias("evidence_json"),
        json_ids(F.array("state_id")).alias("states_json"),
        provenance_id.alias("provenance_id"),
    ).withColumn("value_text", decimal_text(F.col("value")))
    return with_record_id(facts, "derived-fact", "fact_id").drop("value_text", "evidence_json", "states_json", "provenance_id")


def identified_bundles(items: DataFrame, namespace: str, cutoff: Column, by: Sequence[str] = SCOPE) -> DataFrame:
    """One row per scope: how many members each list of the bundle has, and `input_id`.

    items: scope columns, list (a name of BUNDLES[namespace]), item_id, as_of. Newer items than the cutoff are left out, and an item that
    is given several times counts once. A scope without items has no row. Lists are in the order of their identifiers.
    """
    names = BUNDLES[namespace]
    given = items.where((F.col("as_of") <= cutoff) & F.col("list").isin(*names)).select(*by, "list", "item_id").distinct()
    given = materialize(given, "bundles")
    lists = id_lists(given, [*by, "list"], ["item_id"], "item_id")
    wide = lists.groupBy(*by).agg(
        *[F.max(F.when(F.col("list") == name, F.col("ids_json"))).alias(f"{name}_json") for name in names],
        *[F.coalesce(F.max(F.when(F.col("list") == name, F.col("id_count"))), F.lit(0)).alias(f"{name}_count") for name in names],
    )
    named = with_record_id(wide.withColumn("as_of", cutoff), namespace, "input_id")
    return named.drop(*[f"{name}_json" for name in names])


def uncontained(inner: DataFrame, outer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the lower level whose keys the upper level does not hold; a null key is held by a null key."""
    held = outer.select(*[F.col(c).alias(f"_of_{c}") for c in keys]).distinct()
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return inner.join(held, same, "left_anti")

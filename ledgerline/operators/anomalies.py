"""Typed anomaly detectors under per-kind policies; all tolerances are strict."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.errors import ContractError
from ledgerline.functions import Json, decimal_text, is_blank, scope_text, stable_id
from ledgerline.operators.members import id_lists
from ledgerline.operators.state import subject_key
from ledgerline.schemas import SCOPE


@dataclass(frozen=True)
class Policy:
    """A policy id with one non-negative tolerance (days for late commitments)."""

    policy_id: str
    tolerance: Decimal | int = Decimal(0)

    def __post_init__(self) -> None:
        if not self.policy_id.strip():
            raise ContractError("a policy needs an id")
        if not Decimal(self.tolerance).is_finite() or self.tolerance < 0:
            raise ContractError("a tolerance is finite and not negative")

    @property
    def limit(self) -> Column:
        return F.lit(Decimal(self.tolerance)).cast("decimal(38,6)")


@dataclass(frozen=True)
class StatePolicies:
    """Policies of the state detectors. `missing_po.tolerance` is the minimum required quantity."""

    missing_po: Policy = field(default_factory=lambda: Policy("missing-po"))
    quantity_mismatch: Policy = field(default_factory=lambda: Policy("quantity-mismatch"))
    substitution: Policy = field(default_factory=lambda: Policy("substitution"))
    coverage_gap: Policy = field(default_factory=lambda: Policy("coverage-gap"))
    flag_non_current: bool = True


# Kinds in emission order. Kind and severity names.
STATE_KINDS = ("missing_po", "quantity_mismatch", "substitution", "coverage_gap")


def state_anomalies(
    pairs: DataFrame,
    policies: StatePolicies,
    detected_at: Column,
    by: Sequence[str] = SCOPE,
    kinds: Sequence[str] = STATE_KINDS,
) -> DataFrame:
    """All state deviations in one pass over expected/observed pairs.

    A pair without observation can only miss its purchase order. Evidence of an anomaly is that of
    the requirement followed by that of the observation; `state_evidence` lists it.
    """
    wide = "decimal(38,6)"
    required, ordered, unknown, substituted = (
        F.col(name).cast(wide)
        for name in ("required_quantity", "ordered_quantity", "unknown_quantity", "substituted_quantity")
    )
    seen = F.coalesce(F.col("observed"), F.lit(False))
    unordered = ~seen | (ordered <= 0)
    gap = unknown > policies.coverage_gap.limit
    if policies.flag_non_current:
        gap = gap | (F.col("freshness") != "current")
    rules = {
        "missing_po": (
            unordered & (required > policies.missing_po.limit),
            required,
            ordered,
            "warning",
            policies.missing_po,
        ),
        "quantity_mismatch": (
            ~unordered & (F.abs(ordered - required) > policies.quantity_mismatch.limit),
            required,
            ordered,
            "warning",
            policies.quantity_mismatch,
        ),
        "substitution": (
            seen & (substituted > policies.substitution.limit),
            F.lit(0).cast(wide),
            substituted,
            "warning",
            policies.substitution,
        ),
        "coverage_gap": (seen & gap, required, unknown, "info", policies.coverage_gap),
    }
    found = F.array(
        *[
            F.when(
                fires,
                F.struct(
                    F.lit(kind).alias("kind"),
                    expected.alias("expected"),
                    observed.alias("observed"),
                    F.lit(severity).alias("severity"),
                    F.lit("open").alias("status"),
                    F.lit(policy.policy_id).alias("policy_id"),
                ),
            )
            for kind, (fires, expected, observed, severity, policy) in rules.items()
            if kind in kinds
        ]
    )
    keep = [c for c in ("evidence_count", "observed_ordinal") if c in pairs.columns]
    return pairs.select(
        *by,
        "canonical_key",
        *keep,
        subject_key().alias("subject_key"),
        detected_at.alias("detected_at"),
        F.inline(F.filter(found, lambda a: a.isNotNull())),
    )


def state_evidence(
    expected_evidence: DataFrame, observed_evidence: DataFrame, by: Sequence[str] = SCOPE
) -> DataFrame:
    """Evidence of each state: the requirement's first, then the observation's, each id once.

    Inputs carry by, canonical_key, position, evidence_id.
    """
    keys = [*by, "canonical_key"]
    sided = expected_evidence.select(*keys, F.lit(0).alias("side"), "position", "evidence_id").unionByName(
        observed_evidence.select(*keys, F.lit(1).alias("side"), "position", "evidence_id")
    )
    return sided.groupBy(*keys, "evidence_id").agg(F.min(F.struct("side", "position")).alias("place")).select(
        *keys, "evidence_id", "place.side", "place.position"
    )


def anomaly_ids(
    anomalies: DataFrame,
    evidence: DataFrame,
    provenance_id: Column,
    by: Sequence[str] = SCOPE,
) -> DataFrame:
    """Attach anomaly ids. They sort the evidence and ignore severity, status and detection time."""
    keys = [*by, "canonical_key"]
    lists = id_lists(evidence, keys, ["evidence_id"]).select(*keys, "ids_json")
    return anomalies.join(lists, keys, "left").withColumn(
        "anomaly_id",
        stable_id(
            "anomaly",
            F.col("subject_key"),
            scope_text(),
            F.col("kind"),
            F.coalesce(decimal_text(F.col("expected")), F.lit("None")),
            F.coalesce(decimal_text(F.col("observed")), F.lit("None")),
            Json(F.coalesce("ids_json", F.lit("[]"))),
            F.col("policy_id"),
            provenance_id,
        ),
    )


def _emit(
    rows: DataFrame, fires: Column, kind: str, expected: Column, observed: Column, policy: Policy, at: Column
) -> DataFrame:
    passed = [c for c in rows.columns if c not in ("expected", "observed")]
    return rows.where(fires).select(
        *passed,
        F.lit(kind).alias("kind"),
        expected.alias("expected"),
        observed.alias("observed"),
        F.lit("warning").alias("severity"),
        F.lit("open").alias("status"),
        F.lit(policy.policy_id).alias("policy_id"),
        at.alias("detected_at"),
    )


def _beyond(policy: Policy) -> Column:
    expected, observed = (F.col(name).cast("decimal(38,6)") for name in ("expected", "observed"))
    return (expected >= 0) & (observed >= 0) & (F.abs(observed - expected) > policy.limit)


def quantity_mismatch(rows: DataFrame, policy: Policy, detected_at: Column) -> DataFrame:
    """Rows (expected, observed quantity) further apart than the tolerance.

    Negative or missing inputs belong to the validation job and raise no anomaly.
    """
    return _emit(
        rows, _beyond(policy), "quantity_mismatch", F.col("expected"), F.col("observed"), policy, detected_at
    )


def price_deviation(rows: DataFrame, policy: Policy, detected_at: Column) -> DataFrame:
    """Absolute price difference beyond the tolerance."""
    return _emit(
        rows, _beyond(policy), "price_deviation", F.col("expected"), F.col("observed"), policy, detected_at
    )


def late_commitment(rows: DataFrame, policy: Policy, detected_at: Column) -> DataFrame:
    """Observed date later than the expected date plus whole days of tolerance."""
    late = F.col("observed") > F.date_add(F.col("expected"), int(policy.tolerance))
    return _emit(rows, late, "late_commitment", F.col("expected"), F.col("observed"), policy, detected_at)


def stale_revision(rows: DataFrame, policy: Policy, detected_at: Column) -> DataFrame:
    """Observed revision differs from the expected one; blank revisions are invalid input."""
    expected, observed = F.col("expected"), F.col("observed")
    fires = ~is_blank(expected) & ~is_blank(observed) & (expected != observed)
    return _emit(rows, fires, "stale_revision", expected, observed, policy, detected_at)


def unresolved_identity(
    decisions: DataFrame, policy: Policy, detected_at: Column, expected: Column | None = None
) -> DataFrame:
    """One anomaly per unresolved decision with a non-blank mention."""
    rows = decisions.where(F.col("status") == "unresolved").drop("status")
    return _emit(
        rows,
        ~is_blank(F.col("mention")),
        "unresolved_identity",
        F.lit(None).cast("string") if expected is None else expected,
        F.col("mention"),
        policy,
        detected_at,
    )

"""Contract checks as data-quality jobs: rows are split into valid rows and named violations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import errors
from ledgerline.operators.skew import join_owner


@dataclass(frozen=True)
class Rule:
    """A named condition under which a row breaks its contract."""

    name: str
    broken: Callable[[], Column]
    code: str = errors.CONTRACT
    message: str = ""

    def condition(self) -> Column:
        return F.coalesce(self.broken(), F.lit(False))


def violations(rows: DataFrame, row_id: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One row per broken rule, all rules in a single pass."""
    found = F.array(
        *[
            F.when(
                rule.condition(),
                F.struct(
                    F.lit(rule.name).alias("rule"),
                    F.lit(rule.code).alias("error_code"),
                    F.lit(errors.category_of(rule.code)).alias("category"),
                    F.lit(rule.message or rule.name.replace("_", " ")).alias("message"),
                ),
            )
            for rule in rules
        ]
    )
    return rows.select(*row_id, F.inline(F.filter(found, lambda v: v.isNotNull())))


def valid_rows(rows: DataFrame, rules: Sequence[Rule], strict: bool = False) -> DataFrame:
    """Rows that break no rule; a strict job fails at the first row that does."""
    keep = F.lit(True)
    for rule in rules:
        keep = keep & ~rule.condition()
    if strict:
        keep = F.when(keep, F.lit(True)).otherwise(F.raise_error(F.lit(errors.CONTRACT)).cast("boolean"))
    return rows.where(keep)


def split(rows: DataFrame, row_id: Sequence[str], rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, violations)."""
    return valid_rows(rows, rules), violations(rows, row_id, rules)


def with_members(owners: DataFrame, members: DataFrame, keys: Sequence[str], member: str, prefix: str) -> DataFrame:
    """Add `<prefix>_count` and `<prefix>_distinct`: how many members an owner has, and how many differ.

    Counting per (owner, member) first keeps a large owner spread over many tasks.
    """
    single = members.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("_n"))
    totals = single.groupBy(*keys).agg(
        F.sum("_n").alias(f"{prefix}_count"), F.count(F.lit(1)).alias(f"{prefix}_distinct")
    )
    joined = owners.join(totals, list(keys), "left")
    return joined.fillna(0, subset=[f"{prefix}_count", f"{prefix}_distinct"])


def with_strays(
    owners: DataFrame, members: DataFrame, allowed: DataFrame, keys: Sequence[str], member: str, prefix: str
) -> DataFrame:
    """Add `<prefix>_strays`: members of an owner that its allowed set does not hold."""
    outside = members.select(*keys, member).distinct().join(allowed, [*keys, member], "left_anti")
    counts = outside.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}_strays"))
    return owners.join(counts, list(keys), "left").fillna(0, subset=[f"{prefix}_strays"])


def with_offenders(
    owners: DataFrame, members: DataFrame, keys: Sequence[str], offence: str, name: str
) -> DataFrame:
    """Add `name`: how many members of an owner meet a condition over member and owner columns.

    Owner columns are those a member does not have itself.
    """
    own = [c for c in owners.columns if c in keys or c not in members.columns]
    met = join_owner(members, owners.select(*own), keys).where(F.expr(offence))
    counts = met.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return owners.join(counts, list(keys), "left").fillna(0, subset=[name])

"""Keys that hold a large share of all rows, kept out of shuffles that would gather them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bound on the number of keys treated as hot; see `hot_keys`.
HOT_KEYS = 10_000


def hot_keys(counts: DataFrame, keys: Sequence[str], above: int, count: str = "id_count") -> DataFrame:
    """The most frequent keys, few enough to broadcast.

    Fewer than HOT_KEYS keys can hold more than 1/HOT_KEYS of all rows each, so the list holds
    every such key, whatever the data, and never more than HOT_KEYS rows.
    """
    frequent = counts.where(F.col(count) > above).orderBy(F.desc(count), *keys).limit(HOT_KEYS)
    return frequent.select(*keys)


def join_owner(members: DataFrame, owners: DataFrame, keys: Sequence[str], above: int = 1000) -> DataFrame:
    """Join members to the one owner row of their key, however many members a key has.

    Adaptive execution cannot split a skewed join whose output is grouped by the join keys. So the
    owners of hot keys (at most HOT_KEYS rows, as keys are unique) are broadcast to their members,
    and only the other members are shuffled.
    """
    keys = list(keys)
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("id_count"))
    hot = F.broadcast(hot_keys(counts, keys, above))
    hot_owners = F.broadcast(owners.join(hot, keys, "left_semi"))
    return (
        members.join(hot, keys, "left_anti").join(owners, keys).unionByName(members.join(hot_owners, keys))
    )

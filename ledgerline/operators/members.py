"""Ordered lists of any length as one identifier fragment per key, by a hash tree.

The list of a key is written as a JSON array of its members. As long as an array has more than `FANOUT` entries, each run of `FANOUT` entries is
replaced by the identifier of the run. What is left, at most `FANOUT` entries, stands for the whole list: it depends on
every member, on their order and on repetitions.

Lists of up to WHOLE members are made in one task each, from one shuffle by key. Longer ones, which a count by hash buckets of the keys
finds first, are dealt out by range, so that a hot key spreads over tasks and no task holds more than one of its runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import Json, json_ids, stable_id
from ledgerline.session import materialize, no_shuffle_files_left

# Entries of a run. It is part of the identifiers of longer lists.
FANOUT = 1000
# Members up to which a list is made in one task, and hash buckets of keys that are counted to find longer ones.
WHOLE = 100_000
BUCKETS = 1 << 16


def block_id(entries: Column) -> Column:
    """Identifier of a run of entries."""
    return stable_id("block", Json(json_ids(entries)))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with `member`, their place (from 0) in their key by `order`, and `id_count`, how many their key has.

    Rows are range-partitioned and sorted by key and order, numbered where they lie and written once, so a frequent key spreads over many
    partitions. In each partition a key's first number there and its rows in earlier partitions tell the places; these are small tables
    of one row per key and partition.
    """
    keys = list(keys)
    by = [*keys, *order]
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())  # so that equal rows can be split, too
    ranged = salted.repartitionByRange(*by, "_salt").sortWithinPartitions(*by, "_salt").drop("_salt")
    # the number of the partition in the upper 31 bits, the place in it in the lower 33
    fixed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "members")
    placed = fixed.withColumn("_part", F.shiftright("_at", 33))
    part = ["_part", *keys]
    counts = placed.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(c).alias(f"_of_{c}") for c in part],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_start"),
        F.sum("_n").over(of_key).alias("_total"),
    )
    same = F.lit(True)
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return (
        placed.join(materialize(starts, "members"), same)
        .withColumn("member", (F.col("_at") + F.col("_start")).cast("bigint"))
        .withColumn("id_count", F.col("_total"))
        .drop("_at", "_part", "_start", "_total", *[f"_of_{c}" for c in part])
    )


def id_lists(rows: DataFrame, keys: Sequence[str], order: Sequence[str], id_col: str = "evidence_id") -> DataFrame:
    """One row per key: `id_count`, `entries` (what is left of the list, at most FANOUT entries) and `ids_json`, their JSON array.

    Members are ordered by `order`, then by themselves; repeated members count again. Keys without rows have no row.
    """
    keys = list(keys)
    narrow = rows.select(*keys, *[c for c in order if c not in keys and c != id_col], F.col(id_col).alias("_id"))
    sequence = [*["_id" if c == id_col else c for c in order if c not in keys], "_id"]
    sequence = list(dict.fromkeys(sequence))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    crowded = _crowded(narrow, bucket)
    if not crowded:
        return _whole_lists(narrow, keys, sequence)
    whole = _whole_lists(narrow.where(~bucket.isin(crowded)), keys, sequence)
    return whole.unionByName(_spread_lists(narrow.where(bucket.isin(crowded)), keys, sequence))


def _crowded(rows: DataFrame, bucket: Column) -> list[int]:
    """Buckets with more rows than one task should list; every key with so many rows is in one of them."""
    most = min(WHOLE, FANOUT**2)
    with no_shuffle_files_left(rows.sparkSession):
        counted = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        return [row["bucket"] for row in counted.where(F.col("n") > most).collect()]


def _whole_lists(rows: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Lists of keys with at most FANOUT * FANOUT rows, each made in one task."""
    listed = F.sort_array(F.collect_list(F.struct(*sequence)))["_id"]
    grouped = rows.groupBy(*keys).agg(listed.alias("ids"))
    runs = F.sequence(F.lit(0), F.ceil(F.size("ids") / FANOUT).cast("int") - 1)
    nodes = F.transform(runs, lambda run: block_id(F.slice("ids", run * FANOUT + 1, F.lit(FANOUT))))
    made = grouped.select(
        *keys,
        F.size("ids").cast("bigint").alias("id_count"),
        F.when(F.size("ids") <= FANOUT, F.col("ids")).otherwise(nodes).alias("entries"),
    )
    return made.withColumn("ids_json", json_ids(F.col("entries")))


def _spread_lists(rows: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Lists of keys with any number of rows, whose runs are dealt out."""
    members = numbered(rows, keys, sequence)
    nodes = _runs(members, keys, "member", "_id", 1)
    longest = members.agg(F.max("id_count").alias("n")).first()["n"] or 0
    if longest > FANOUT:
        nodes = materialize(nodes, "members")
    roots, below = nodes.where("root"), 1
    while longest > FANOUT**below:
        nodes = _runs(nodes.where("NOT root"), keys, "run", "node", below + 1)
        if longest > FANOUT ** (below + 1):
            nodes = materialize(nodes, "members")
        roots = roots.unionByName(nodes.where("root"))
        below += 1
    return roots.select(*keys, "id_count", "entries", json_ids(F.col("entries")).alias("ids_json"))


def _runs(entries: DataFrame, keys: list[str], place: str, value: str, level: int) -> DataFrame:
    """Runs of a level: `root` and `entries` if the run is all that its key has, else `node`, its identifier."""
    grouped = entries.groupBy(*keys, "id_count", F.floor(F.col(place) / FANOUT).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.col(value).alias("id"))))["id"].alias("entries")
    )
    root = F.col("id_count") <= F.lit(FANOUT**level)
    return grouped.select(
        *keys, "id_count", "run", root.alias("root"), F.when(root, F.col("entries")).alias("entries"),
        F.when(~root, block_id(F.col("entries"))).alias("node"),
    )

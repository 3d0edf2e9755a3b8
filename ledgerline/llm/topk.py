"""Exact top-k search by no-random-access aggregation over sorted lists.

Every component of the candidates of a block is a sorted list, read from its large end for queries with a positive weight and from its small end
for negative ones. After a depth of reading, a candidate's score lies between its seen part plus the least and plus the most that its unseen
parts can add (what the lists have at the depth). Reading stops when few candidates can still reach the k-th best lower bound; only their
final scores are resolved. Blocks of queries meet blocks of candidates in groups of bounded size, and each query's best of all blocks
are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import Stash
from ledgerline.session import ship_package

CANDIDATES = 4096
QUERIES = 512
# Shares of the lists after which bounds are looked at, and the number of open candidates per query at which reading ends.
DEPTHS = (0.25, 0.5, 0.75)
OPEN = 48
EXACT = 2.0**53


def open_candidates(queries: np.ndarray, block: np.ndarray, k: int, barred: np.ndarray) -> np.ndarray:
    """(queries, candidates) booleans: who can still be among the best k when reading stops; barred ones count for nothing."""
    n = len(block)
    rank = np.empty(block.shape, dtype=np.int64)
    order = np.argsort(-block, axis=0, kind="stable")
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(block, order, axis=0)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    least = plus * ordered[-1] + minus * ordered[0]  # what a list adds at its very end
    left = ~barred
    for share in DEPTHS:
        depth = max(k, int(n * share))
        if depth >= n:
            break
        top, bottom = rank < depth, rank >= n - depth
        seen = plus @ (block * top).T + minus @ (block * bottom).T
        most_plus, most_minus = plus * ordered[depth - 1], minus * ordered[n - depth]
        upper = seen + most_plus @ (~top).T.astype(float) + most_minus @ (~bottom).T.astype(float)
        low_plus, low_minus = np.where(queries > 0, least, 0), np.where(queries < 0, least, 0)
        lower = seen + low_plus @ (~top).T.astype(float) + low_minus @ (~bottom).T.astype(float)
        lower[barred] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(queries), -np.inf)
        left = (upper >= bar[:, None]) & ~barred  # an equal bound may still tie
        if left.sum() <= OPEN * len(queries):
            break
    return left


def best_of_block(
    queries: np.ndarray, block: np.ndarray, own: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its number, the ids and the exact scores of its best k of the block; own is each query's row key, which doesn't count among keys."""
    barred = own[:, None] == keys[None, :]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(1, block.shape[1])
    floats = block.astype(np.float64) if bound < EXACT else None
    # sums beyond the exact integers of double precision get no bounds, and are resolved one by one
    left = ~barred if floats is None else open_candidates(queries.astype(np.float64), floats, k, barred)
    for q in range(len(queries)):
        at = np.flatnonzero(left[q])
        if floats is not None:
            score = (floats[at] @ queries[q].astype(np.float64)).astype(np.int64)
        else:
            score = np.array([sum(int(a) * int(b) for a, b in zip(block[c], queries[q], strict=True)) for c in at], dtype=np.int64)
        best = np.lexsort((ids[at], -score))[:k]
        yield q, ids[at[best]], score[best]


def codes(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best k rows for each row for which is_query (over column vec_id) holds.

    Scores are inner products of floor(256 x) integers; ties go to the smaller id. Null vectors and vectors with null or non-finite
    components take no part, nor do null ids. Every row counts by itself: rows that repeat an id or a vector are candidates of each other,
    and each query row is answered.
    Vectors of different lengths do not meet. Queries with fewer candidates get all; an empty table gives no rows; other columns are not read.
    Scores beyond 64 bits fail the job.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    stash = Stash(spark, "topk")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite)
    coded = stash.put(sound.select(F.monotonically_increasing_id().alias("key"), "vec_id", codes(F.col("v")).alias("c")))
    dims = F.size("c").alias("dims")
    counts = {
        r["dims"]: (r["n"], r["q"])
        for r in coded.groupBy(dims).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()
    }
    sizes = spark.createDataFrame(
        [(d, max(1, -(-n // CANDIDATES)), max(1, -(-q // QUERIES))) for d, (n, q) in counts.items()],
        "dims int, c_blocks int, q_blocks int",
    )
    placed = coded.withColumn("dims", F.size("c")).join(F.broadcast(sizes), "dims")  # one row per vector length
    place = F.xxhash64("key")
    candidates = placed.select(
        "dims", F.pmod(place, F.col("c_blocks")).cast("int").alias("c_block"),
        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block"), F.lit(False).alias("asks"), "key", "vec_id", "c",
    )
    asking = placed.where(is_query).select(
        "dims", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)).alias("c_block"),
        F.pmod(place, F.col("q_blocks")).cast("int").alias("q_block"), F.lit(True).alias("asks"), "key", "vec_id", "c",
    )

    def best(group: pa.Table) -> pa.Table:
        asks = np.asarray(group.column("asks").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
        ids, keys = group.column("vec_id").to_numpy(), group.column("key").to_numpy()
        dims = group.column("dims")[0].as_py()
        values = np.array(group.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
        values = values.reshape(len(ids), dims)
        out: tuple[list, list, list, list] = ([], [], [], [])
        if asks.any() and not asks.all():
            own, named, queries = keys[asks], ids[asks], values[asks]
            for q, found, score in best_of_block(queries, values[~asks], own, keys[~asks], ids[~asks], k):
                out[0].extend([int(own[q])] * len(found))
                out[1].extend([int(named[q])] * len(found))
                out[2].extend(found.tolist())
                out[3].extend(score.tolist())
        return pa.table([pa.array(v, pa.int64()) for v in out], names=["key", "query_id", "vec_id", "score"])

    found = candidates.union(asking).groupBy("dims", "c_block", "q_block").applyInArrow(
        best, "key long, query_id long, vec_id long, score long"
    )
    order = W.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

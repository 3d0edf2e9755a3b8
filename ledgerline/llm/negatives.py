"""Hard-negative mining over STR-packed R-trees.

Rows are ordered by label and by the coordinates that vary most, and cut into blocks of about `BLOCK` rows by range partitions. A task packs the rows of
its block into an R-tree by sort-tile-recursive: slabs by the most varying coordinate, slabs of those by the next, leaves, and boxes of boxes. The minimum
bounding box of a node gives an interval for each coordinate's part of an inner product, and so for the score. A query takes nodes from
a queue, highest upper bound first, and leaves out those that lie outside all its score windows or strictly below the k-th score found.

A block is read once and never copied; the queries of a search stream past the tree in batches. Positives are searched in the blocks of their label.
Negatives are searched twice: in one block of `SEED` first, then in the others with the k-th scores found as lower ends of the windows, so that
the other blocks return few rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import Stash, arrow_batches

BLOCK = 8192
LEAF = 128
FAN = 16
TILED = 3  # coordinates that tiles are cut by
SEED = 16
ASKING = 512  # queries whose bounds are computed at once
EXACT = 2.0**53
NO_ID = 2**63 - 1  # stands for a null id, which comes last in ties
ANY = 2**63 - 1


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as exact whole doubles, or as Python integers where doubles would lose some."""
    if np.abs(vectors).max(initial=0) < 2.0**45:
        return np.floor(256.0 * vectors)
    exact = [[math.floor(256.0 * x) if abs(x) < EXACT else int(x) * 256 for x in row] for row in vectors.tolist()]
    return np.array(exact, dtype=object).reshape(vectors.shape)


def tiles(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf, packed by sort-tile-recursive over the coordinates that vary most."""
    spread = points.astype(np.float64).std(axis=0) if len(points) else np.zeros(points.shape[1])
    axes = np.argsort(-spread, kind="stable")[:TILED].tolist()

    def cut(rows: np.ndarray, axes: list[int]) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or not axes:
            return [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
        rows = rows[np.argsort(points[rows, axes[0]], kind="stable")]
        slabs = math.ceil(leaves ** (1 / len(axes)))
        size = -(-leaves // slabs) * leaf
        return [part for i in range(0, len(rows), size) for part in cut(rows[i : i + size], axes[1:])]

    return cut(np.arange(len(points)), axes)


class Tree:
    """A packed R-tree over whole vectors with ids, labels and row keys; labels have an interval in each box like coordinates."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, keys: np.ndarray) -> None:
        leaves = tiles(points)
        order = np.concatenate([np.zeros(0, dtype=np.int64), *leaves])
        self.points, self.ids, self.labels, self.keys = points[order], ids[order], labels[order], keys[order]
        self.leaves = len(leaves)
        ends = np.cumsum([len(part) for part in leaves]).tolist()
        self.spans = list(zip([0, *ends[:-1]], ends, strict=True))
        low = [self.points[a:b].min(axis=0) for a, b in self.spans]
        high = [self.points[a:b].max(axis=0) for a, b in self.spans]
        tags = [(int(self.labels[a:b].min()), int(self.labels[a:b].max())) for a, b in self.spans]
        self.children: list[range] = [range(0)] * self.leaves
        level = range(self.leaves)
        while len(level) > 1:
            above = []
            for start in range(level.start, level.stop, FAN):
                below = range(start, min(start + FAN, level.stop))
                above.append(below)
                low.append(np.minimum.reduce([low[i] for i in below]))
                high.append(np.maximum.reduce([high[i] for i in below]))
                tags.append((min(tags[i][0] for i in below), max(tags[i][1] for i in below)))
            self.children += above
            level = range(level.stop, level.stop + len(above))
        self.root = len(low) - 1
        self.low, self.high, self.tags = np.array(low), np.array(high), tags
        self.size = float(np.abs(self.points).max(initial=0))
        self.scored = 0  # inner products computed, for tests

    def ask(self, queries: np.ndarray, labels: list[int], own: list[int], windows: list[list[tuple[int, int]]], same: bool, k: int) -> Iterator[list[list[tuple[int, int]]]]:
        """Per query and window its best k (score, id): rows with the query's label, or with another, but for the row of key `own`."""
        points, low, high = self.points, self.low, self.high
        if queries.dtype == object or points.dtype == object or float(np.abs(queries).max(initial=0)) * self.size * points.shape[1] >= EXACT:
            queries, points, low, high = (exactly(a) for a in (queries, points, low, high))
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        upper = (plus @ high.T + minus @ low.T).tolist()
        lower = (plus @ low.T + minus @ high.T).tolist()
        for q in range(len(queries)):
            yield self._best(points, queries[q], upper[q], lower[q], labels[q], own[q], windows[q], same, k)

    def _best(self, points: np.ndarray, query: np.ndarray, upper: list, lower: list, label: int, own: int, windows: list[tuple[int, int]], same: bool, k: int) -> list[list[tuple[int, int]]]:
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        floors = [window[0] for window in windows]

        def wanted(node: int) -> bool:
            low, high = self.tags[node]
            if not low <= label <= high if same else low == label == high:
                return False
            return any(upper[node] >= floor and lower[node] <= window[1] for floor, window in zip(floors, windows, strict=True))

        queue = [(-upper[self.root], self.root)] if wanted(self.root) else []
        while queue:
            reach, node = heapq.heappop(queue)
            if -reach < min(floors):
                break  # all that is left lies strictly below
            if not wanted(node):
                continue
            if node >= self.leaves:
                for child in self.children[node]:
                    if wanted(child):
                        heapq.heappush(queue, (-upper[child], child))
                continue
            a, b = self.spans[node]
            scores = points[a:b] @ query
            self.scored += b - a
            fits = ((self.labels[a:b] == label) == same) & (self.keys[a:b] != own)
            for w, (_, most) in enumerate(windows):
                at = np.flatnonzero(fits & (scores >= floors[w]).astype(bool) & (scores <= most).astype(bool))
                if len(at):
                    found = [(-int(s), i) for s, i in zip(scores[at].tolist(), self.ids[a:b][at].tolist(), strict=True)]
                    best[w] = heapq.nsmallest(k, best[w] + found)
                    if len(best[w]) == k:
                        floors[w] = max(floors[w], -best[w][-1][0])
        return [[(-s, i) for s, i in rows] for rows in best]


def exactly(values: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers."""
    if values.dtype == object:
        return values
    return np.array([[int(x) for x in row] for row in values.tolist()], dtype=object).reshape(values.shape)


FOUND = "key long, p long, vec_id long, score long"


def _searching(same: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block, the block's own first, then its queries."""
        block, trees, held, asked = None, {}, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal held, trees
            if held:
                trees, held = _planted(held), []
            columns: tuple[list, list, list, list] = ([], [], [], [])
            for dims in {len(row["v"]) for row in asked}:
                some = [row for row in asked if len(row["v"]) == dims]
                if dims not in trees:
                    continue
                windows = [[(w["low"], w["high"]) for w in row["windows"]] for row in some]
                queries = whole(np.array([row["v"] for row in some], dtype=np.float64).reshape(len(some), dims))
                told = trees[dims].ask(queries, [row["label"] for row in some], [row["key"] for row in some], windows, same, k)
                for row, lists in zip(some, told, strict=True):
                    for w, pairs in zip(row["windows"], lists, strict=True):
                        for score, vec_id in pairs:
                            for column, value in zip(columns, (row["key"], w["p"], vec_id, score), strict=True):
                                column.append(value)
            asked.clear()
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "p", "vec_id", "score"])

        for batch in batches:
            for start in range(0, batch.num_rows, ASKING):
                for row in batch.slice(start, ASKING).to_pylist():
                    if row["block"] != block:
                        yield from answers()
                        block, trees, held = row["block"], {}, []
                    if row["asks"]:
                        asked.append(row)
                    else:
                        held.append(row)
                    if len(asked) >= ASKING:
                        yield from answers()
        yield from answers()

    return run


def _planted(rows: list[dict]) -> dict[int, Tree]:
    """A tree per vector length (a block has one, or a few where lengths change)."""
    trees = {}
    for dims in {len(row["v"]) for row in rows}:
        some = [row for row in rows if len(row["v"]) == dims]
        points = whole(np.array([row["v"] for row in some], dtype=np.float64).reshape(len(some), dims))
        trees[dims] = Tree(points, *(np.array([row[name] for row in some], dtype=np.int64) for name in ("vec_id", "label", "key")))
    return trees


def _search(blocks: DataFrame, asking: DataFrame, same: bool, k: int) -> DataFrame:
    """(key, p, vec_id, score) of the best k of each block for each query and window; asking: block, key, label, v, windows."""
    width = "array<struct<p:bigint,low:bigint,high:bigint>>"
    rows = blocks.select("block", F.lit(0).alias("asks"), "key", "vec_id", "label", "v", F.lit(None).cast(width).alias("windows"))
    queries = asking.select("block", F.lit(1).alias("asks"), "key", F.lit(NO_ID).alias("vec_id"), "label", "v", F.col("windows").cast(width).alias("windows"))
    dealt = rows.union(queries).repartition("block").sortWithinPartitions("block", "asks")
    return arrow_batches(dealt, _searching(same, k), FOUND)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row for which is_anchor (over vec_id) holds.

    Scores are inner products of floor(256 x) integers; higher ones come first, ties go by the smaller id, a null id comes last. An anchor's positives are its
    first `positives` other rows of the same label; for each, the first `negatives` rows of other labels whose score lies between
    low and high hundredths of the positive's are returned. Rows with a null label or vector, or with a null or non-finite component,
    take no part; vectors of different lengths don't meet. Every row counts by itself: rows that repeat an id or a vector are other rows. An anchor without
    positives or without fitting negatives gives no rows, nor does an empty table; other columns are not read. A returned score beyond
    64 bits fails the job. Of rows that share label and vector only the smallest ids can be among the first, so only those are indexed.
    """
    spark = vectors.sparkSession
    stash = Stash(spark, "negatives")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = vectors.select(
        F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    rows = stash.put(given.where("label IS NOT NULL AND v IS NOT NULL").where(finite).withColumn("key", F.monotonically_increasing_id()))
    alike = W.partitionBy("label", "v").orderBy("vec_id", "key")
    distinct = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= max(positives + 1, negatives)).drop("n", "anchor")
    distinct = stash.put(distinct)

    wide = distinct.select(F.size("v").alias("dims"), F.posexplode("v").alias("axis", "x")).groupBy("axis").agg(F.stddev("x").alias("s"))
    axes = [r["axis"] for r in wide.orderBy(F.desc("s"), "axis").limit(TILED).collect()]
    count = max(1, -(-distinct.count() // BLOCK))
    order = [F.size("v"), F.col("label"), *[F.get("v", F.lit(axis)) for axis in axes], F.col("key")]
    blocks = stash.put(distinct.repartitionByRange(count, *order).withColumn("block", F.spark_partition_id()))
    kinds = stash.put(blocks.groupBy(F.size("v").alias("dims"), "block", "label").count())

    anchors = stash.put(rows.where("anchor").withColumn("dims", F.size("v")).drop("anchor"))
    window = lambda p, a, b: F.struct(p.cast("long").alias("p"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    open_ = F.array(window(F.lit(0), F.lit(-ANY), F.lit(ANY)))
    near = anchors.join(kinds.select("dims", "label", "block"), ["dims", "label"]).withColumn("windows", open_)
    chosen = stash.put(_ranked(_search(blocks, near, True, positives), ["key"], positives).select(
        "key", F.col("vec_id").alias("positive_id"), F.col("score").alias("p")
    ))

    # 30 p <= 100 n <= 90 p over integers; a negative p has no such n
    quotient = lambda x: F.floor(x / F.lit(100).cast("decimal(20,0)"))
    exact = F.col("p").cast("decimal(24,0)")
    least, most = -quotient(-exact * low), quotient(exact * high)
    spans = chosen.where("p >= 0").select("key", "p").distinct().select("key", window(F.col("p"), least, most).alias("w"))
    other = kinds.groupBy("dims", "block").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    asked = stash.put(spans.where("w.low <= w.high").groupBy("key").agg(F.collect_list("w").alias("windows")).join(anchors, "key"))  # at most one window a positive
    pairs = asked.join(other, "dims").where("NOT (a = label AND b = label)")
    seed = F.col("block") % SEED == 0
    first = stash.put(_search(blocks.where(seed), pairs.where(seed), False, negatives))
    floors = _ranked(first, ["key", "p"], negatives).where(F.col("rank") == negatives).select("key", "p", F.col("score").alias("floor"))
    raised = asked.select("key", F.explode("windows").alias("w")).select("key", "w.*").join(floors, ["key", "p"], "left").groupBy("key").agg(
        F.collect_list(window(F.col("p"), F.greatest("low", "floor"), F.col("high"))).alias("windows")
    )
    rest = pairs.where(~seed).drop("windows").join(raised, "key")
    found = _ranked(first.union(_search(blocks.where(~seed), rest, False, negatives)), ["key", "p"], negatives)
    names = anchors.select("key", F.col("vec_id").alias("anchor_id"))
    null_id = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    told = chosen.join(found.withColumnRenamed("vec_id", "negative_id"), ["key", "p"]).join(names, "key")
    return told.select(
        null_id("anchor_id"), null_id("positive_id"), F.col("rank").cast("int").alias("rank"), null_id("negative_id"),
        F.col("p").alias("positive_score"), F.col("score").alias("negative_score"),
    )

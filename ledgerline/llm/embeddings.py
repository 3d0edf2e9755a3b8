"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A vector is padded to a power of two, turned by three rounds of random signs and a fast Hadamard transform, and hashed to the
signed axis that is closest to it. A table's bucket joins several such hashes; multiprobe adds the buckets in which the least certain
hash takes its next best axis. Vectors that share a bucket are compared by cosine in double precision.

Equal vectors are one class and are compared once. Each bucket is dealt out in chunks of at most `CHUNK` classes, and a task sees two chunks at a
time, so a bucket with any share of all vectors spreads over many tasks. A pair that meets in several buckets is
counted only in the first they share, so link counts need no list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Stash, arrow_batches, components

COSINE = 0.95
TABLES = 10
PROBES = 3  # buckets per table, the vector's own included
CHUNK = 1024
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    width, half = x.shape[1], 1
    x = x.copy()
    while half < width:
        y = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), width)
        half *= 2
    return x / math.sqrt(width)


def hashes_per_table(rows: int, width: int) -> int:
    """As many hashes as leave few unrelated vectors in a bucket, at any number of rows."""
    return max(2, round(math.log(max(2, rows)) / math.log(2 * width)))


def buckets(x: np.ndarray, dims: int, hashes: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, probes) bucket keys of unit vectors; keys of different tables differ."""
    width = 1 << max(1, (dims - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, :dims] = x
    out = np.zeros((len(x), tables, probes), dtype=np.int64)
    rng = np.random.default_rng(SEED + width)
    for table in range(tables):
        best = np.zeros((len(x), hashes), dtype=np.int64)
        second = np.zeros((len(x), hashes), dtype=np.int64)
        doubt = np.zeros((len(x), hashes))
        for h in range(hashes):
            y = padded
            for signs in rng.choice([-1.0, 1.0], (3, width)):
                y = hadamard(y * signs)
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            rows = np.arange(len(x))[:, None]
            top = np.take_along_axis(top, np.argsort(-size[rows, top], axis=1), axis=1)
            axes = 2 * top + (y[rows, top] < 0)
            best[:, h], second[:, h] = axes[:, 0], axes[:, 1]
            doubt[:, h] = size[rows, top][:, 0] - size[rows, top][:, 1]
        order = np.argsort(doubt, axis=1)
        for probe in range(probes):
            codes = best.copy()
            if 0 < probe <= hashes:
                rows = np.arange(len(x))
                at = order[:, probe - 1]
                codes[rows, at] = second[rows, at]
            key = np.full(len(x), ((table + 1) << 40) + (dims << 16), dtype=np.uint64)  # clear of the axis codes
            for h in range(hashes):
                key = (key ^ codes[:, h].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, table, probe] = key.view(np.int64)
    return out


def _hasher(hashes_of: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            keys: list = [None] * len(vectors)
            units: list = [None] * len(vectors)
            for dims in set(sizes.tolist()):
                at = np.flatnonzero(sizes == dims)
                x = np.array([vectors[i] for i in at], dtype=np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = buckets(x, dims, hashes_of[dims]).reshape(len(at), -1)
                for i, row, unit in zip(at, found, x, strict=True):
                    keys[i], units[i] = row, unit.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(units, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["cid", "members", "unit", "keys"],
            )

    return run


def _linker(cosine: float):
    """Reads rows sorted by (bucket, one, two) and links each group."""

    def group(rows: dict[str, list]) -> tuple[list, list, list]:
        chunk = np.array(rows["chunk"])
        left, right = np.flatnonzero(chunk == rows["one"][0]), np.flatnonzero(chunk == rows["two"][0])
        same = rows["one"][0] == rows["two"][0]
        if len(left) == 0 or len(right) == 0 or same and len(left) == 1:
            return [], [], []
        x = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(len(chunk), -1)
        i, j = np.nonzero(x[left] @ x[right].T >= cosine)
        i, j = left[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return [], [], []
        keys = np.array(rows["keys"], dtype=np.int64).reshape(len(chunk), -1, PROBES)
        bucket = rows["bucket"][0]
        table = int(np.flatnonzero((keys[i[0]] == bucket).any(axis=1))[0])
        mine = np.ones(len(i), dtype=bool)
        for earlier in range(table + 1):  # the first table in which a pair meets owns it, there its smallest bucket
            on = np.flatnonzero(mine)
            if not len(on):
                return [], [], []
            a, b = keys[i[on], earlier][:, :, None], keys[j[on], earlier][:, None, :]
            met = a == b
            if earlier == table:
                met &= a < bucket
            mine[on[met.any(axis=(1, 2))]] = False
        i, j = i[mine], j[mine]
        if not len(i):
            return [], [], []
        members = np.array(rows["members"], dtype=np.int64)
        links = np.zeros(len(chunk), dtype=np.int64)
        np.add.at(links, i, members[j])
        np.add.at(links, j, members[i])
        root = np.arange(len(chunk))
        while True:  # smallest reachable row, by hooking and pointer jumping
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            np.minimum.at(low, root, low)
            low = low[low]
            if (low == root).all():
                break
            root = low
        cids = np.array(rows["cid"], dtype=np.int64)
        touched = np.flatnonzero(links)
        return cids[touched].tolist(), links[touched].tolist(), cids[root[touched]].tolist()

    names = ["bucket", "one", "two", "chunk", "cid", "members", "unit", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {name: [] for name in names}
        last = None
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(held["cid"]) > 1:
                for total, part in zip(out, group(held), strict=True):
                    total.extend(part)
            for name in names:
                held[name] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["cid", "links", "root"])

        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(names)}
            marks = np.stack([np.asarray(columns[name]) for name in names[:3]], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), len(marks)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                mark = tuple(marks[start])
                if mark != last:
                    close()
                    last = mark
                for name in names:
                    held[name].extend(columns[name].slice(start, stop - start).to_pylist())
            if len(out[0]) > 50_000:
                yield batch_of()
                out = ([], [], [])
        close()
        yield batch_of()

    return run


def valid(vector) -> F.Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & numbers & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    n_links counts the other rows with a cosine of at least `cosine` that hashing finds; every link counted is verified. Vectors without a
    direction (see `valid`) link with nothing, and so do vectors of different lengths. Repeated rows are vectors of their own that link with each
    other. A null id takes part in links; component_id is the smallest id of the component that is not null, and null if there is none.
    An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    stash = Stash(spark, "embeddings")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = rows.where(valid(F.col("v")))
    grouped = sound.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("members"))
    classes = stash.put(grouped.withColumn("cid", F.monotonically_increasing_id()))  # fixed by being written
    dims = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    hashes_of = {d: hashes_per_table(n, 1 << max(1, (d - 1).bit_length())) for d, n in dims.items()}
    hashed = stash.put(
        arrow_batches(
            classes.select("cid", "members", "v").repartition("cid"), _hasher(hashes_of), "cid long, members long, unit binary, keys array<long>"
        )
    )
    counts = hashed.select(F.explode(F.array_distinct("keys")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    chunks = counts.where("n > 1").select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = (
        hashed.select("cid", "members", "unit", "keys", F.explode(F.array_distinct("keys")).alias("bucket"))
        .join(chunks, "bucket")
        .withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "bucket", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("two"), "chunk",
            "cid", "members", "unit", "keys",
        )
        .repartition("bucket", "one", "two")
        .sortWithinPartitions("bucket", "one", "two")
    )
    found = stash.put(arrow_batches(dealt, _linker(cosine), "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "embedding-components")
    placed = classes.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "v", "low", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    known = placed.join(lowest, "root").select("v", "n_links", "component_id")
    linked = sound.join(known, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

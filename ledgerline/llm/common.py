"""What several operators share: materialized intermediates, connected components, arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import CLEANUP, no_shuffle_files_left, scratch_path, ship_package  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stash:
    """Intermediate tables written once to the shared folder, so that a lost executor costs no recomputation.

    `put` writes a table and reads it back; `drop` deletes one that no later plan reads. Shuffle files of a write go as soon as its table
    is there, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.label = label
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        with no_shuffle_files_left(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def put_dealt(self, df: DataFrame, column: str) -> DataFrame:
        """`put` of a table that is bucketed by `column`, so that joins and groups by it shuffle nothing of it."""
        path = scratch_path(self.spark, self.label)
        name = "spark_catalog.default.dealt_" + path.rpartition("-")[2]
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with no_shuffle_files_left(self.spark):
            df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name, format="parquet")
        back = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # only the name goes; the files lie at a path of their own
        self.paths[id(back)] = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path is None:
            return
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of undirected `edges` (a, b): root is the smallest node it can reach.

    Distributed union-find: a parent table is hooked to the smallest grandparent among neighbours and
    shortened by pointer jumping until no parent changes, which takes a logarithmic number of rounds. Each
    round is joins and combining aggregates over tables of nodes and edges; nothing is collected but one sum.
    Self-loops and repeated edges are harmless; edges with a null end are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    stash = Stash(spark, label)
    known = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stash.put(known.select("a", "b").union(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parents = stash.put(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
    )
    total = _parent_sum(parents)
    while True:
        up = parents.select(F.col("node").alias("up"), F.col("root").alias("grand"))
        lifted = parents.join(up, F.col("root") == F.col("up")).select("node", "root", "grand")
        # grand never exceeds root; naming both lets the two joins of `lifted` read one shuffle
        offers = (
            both.join(lifted, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min(F.least("grand", "root")).alias("offer"))
        )
        hooked = lifted.join(offers, F.col("node") == F.col("a"), "left").select(
            F.explode(
                F.array(
                    F.struct("node", F.least("grand", "offer").alias("root")),
                    F.struct(F.col("root").alias("node"), F.least("grand", "offer").alias("root")),
                )
            ).alias("x")
        )
        moved = stash.put(hooked.groupBy(F.col("x.node").alias("node")).agg(F.min("x.root").alias("root")))
        after = _parent_sum(moved)
        stash.drop(parents)
        parents = moved
        if after == total:
            stash.drop(both)
            return parents
        total = after


def _parent_sum(parents: DataFrame) -> object:
    """A number that changes when a parent does."""
    return parents.agg(F.sum(F.xxhash64("root").cast("decimal(38,0)"))).first()[0]


def arrow_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package available on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def texts_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch with its texts; null counts as empty."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).to_pylist()
        yield batch, [value or "" for value in values]


class Recent:
    """What words are encoded to, for words met lately, in at most about twice `most` bytes.

    Words of the present generation answer at once; those of the last one move over when they are met again; when the present one is full,
    it becomes the last, and what was not met since then is forgotten. So frequent words stay for ever, rare ones make room, and
    words that first occur late are taken in, too.
    """

    ENTRY = 160  # bytes that an entry takes besides its word and value

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int) -> None:
        self.encode = encode
        self.most = most
        self.now: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.held = 0

    def joined(self, parts: list[list[str]]) -> list[bytes]:
        """For each list of words the values of its words, joined."""
        now, last = self.now, self.last
        missing = set().union(*parts).difference(now)
        new = []
        for word in missing:
            value = last.get(word)
            if value is None:
                new.append(word)
            else:
                now[word] = value
                self.held += self.ENTRY + len(word) + len(value)
        for word, value in zip(new, self.encode(new), strict=True):
            now[word] = value
            self.held += self.ENTRY + len(word) + len(value)
        out = [b"".join(map(now.__getitem__, words)) for words in parts]
        if self.held > self.most:
            self.last, self.now, self.held = now, {}, 0
        return out

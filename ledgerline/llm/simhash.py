"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints are 64 bits wide; two of them are linked if at most `RADIUS` bits differ. Every bit position gets a
non-zero vector of RADIUS + 1 bits, and each of the 2^(RADIUS+1) - 1 non-zero query vectors q defines a mask of
the positions whose vector has an odd product with q. For any RADIUS positions some q has an even product with all of them, so
any two fingerprints within the radius agree under that mask: they share a bucket in at least one table, without
exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerline.llm.common import Stash, arrow_batches, components

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
# Buckets up to this many fingerprints are compared pair by pair; larger ones go through their one-bit neighbours.
PAIRWISE = 24


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Masks as signed 64-bit integers, one per table."""
    vectors = [1 + position % (2 ** (radius + 1) - 1) for position in range(BITS)]
    masks = []
    for query in range(1, 2 ** (radius + 1)):
        mask = sum(1 << p for p, vector in enumerate(vectors) if (vector & query).bit_count() % 2)
        masks.append(mask - 2**64 if mask >= 2**63 else mask)
    return masks


def fingerprint_of(text: str) -> int:
    """SimHash of the text's word shingles, as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(shingle, SEED) for shingle in shingles], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([fingerprint_of(text or "") for text in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row, in the order of the input partitions."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_batches(rows, _fingerprints, "doc_id long, fp long")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_links(prints: DataFrame, radius: int = RADIUS, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) exactly as all links within the radius do.

    Buckets of up to `pairwise` fingerprints give their verified pairs. In a larger bucket fingerprints that lie within
    one bit of a common value are tied to that value (for radius 2 these are exactly the pairs within the radius), which costs
    one row per unmasked bit instead of one per pair; ties through other values are resolved to fingerprints.
    """
    if radius != 2:
        raise ValueError("links are built for a radius of 2 bits")
    masks = covering_masks(radius)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("tab", "mask")).select(
        "fp", "tab", (F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "mask"
    )
    sizes = keyed.groupBy("tab", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    crowded = keyed.join(sizes, ["tab", "bucket"])
    small = crowded.where(F.col("size") <= pairwise).select("tab", "bucket", "fp")
    pairs = (
        small.withColumnRenamed("fp", "a")
        .join(small.withColumnRenamed("fp", "b"), ["tab", "bucket"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
    )
    large = crowded.where(F.col("size") > pairwise).select("fp", "mask").distinct()
    bits = F.array(*[F.lit(0).cast("long")], *[F.lit((1 << p) - (2**64 if p == 63 else 0)).cast("long") for p in range(BITS)])
    around = (
        large.select("fp", "mask", F.explode(bits).alias("bit"))
        .where(F.col("bit").bitwiseAND(F.col("mask")) == 0)
        .select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("middle"))
        .distinct()
    )
    centres = around.groupBy("middle").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    ties = around.join(centres, "middle").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(ties).distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint and group of every document: doc_id, fp, component_id, keep_fp, root_fp.

    Links join fingerprints at most 2 bits apart; a group is what links can reach. component_id is the group's
    smallest id; (component_id, keep_fp) name the row that stays. One row per input row: repeated rows repeat, a null
    text counts as empty (fingerprint zero, linked like any other), a null id never becomes component_id unless its
    group has no other, and columns besides id and text are not looked at. An empty table gives no rows.
    """
    stash = Stash(docs.sparkSession, "simhash")
    prints = stash.put(fingerprints(docs, doc_id, text))
    classes = stash.put(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(near_links(classes.select("fp")), "simhash-groups")
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root_fp")
    )
    first = placed.groupBy("root_fp").agg(
        F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("first")
    )
    groups = placed.join(first, "root_fp").select(
        "fp", "root_fp", F.col("first.low").alias("component_id"), F.col("first.fp").alias("keep_fp")
    )
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id", "keep_fp", "root_fp")


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group the row with the smallest id, once. All columns are kept."""
    names = docs.columns
    stays = (
        simhash_groups(docs, doc_id, text)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keep_fp")))
        .select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"))
        .distinct()
    )
    numbered = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"),
        F.col(doc_id).cast("long").alias("__key"),
        _fingerprint_column(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__print"),
    )
    kept = numbered.join(
        stays, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__fp")), "left_semi"
    ).dropDuplicates(["__key", "__print"])
    return kept.select("row.*")


@F.pandas_udf(LongType())
def _fingerprint_column(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint_of)

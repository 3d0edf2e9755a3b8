"""Mixing sources to target weights by Poisson replication.

A source with target weight w and a share s of all documents has the mean repetition rate w / s (times the wanted size of
the mixture). Every document draws its own number of copies from the Poisson distribution with that mean by inverting it at a
uniform number hashed from seed, id, text and part, so the draw is the same in every run and on every cluster. Copies
are ordered by another hash, which shuffles the whole mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Stash

# A mean above this is split into equal parts whose draws are added: e^-mean stays far from underflow.
PART_MEAN = 16.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1): the first 52 bits of an MD5 digest of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def cumulative(mean: Column) -> Column:
    """Poisson distribution function of `mean` at 0, 1, ... up to where double precision cannot tell it from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + term)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["sums"])


def source_rates(docs: DataFrame, source: str = "source", temperature: float = 0.5, size: float = 1.0,
                 weights: DataFrame | None = None) -> DataFrame:
    """One row per source: source, n_docs, rate, parts, sums (the distribution function of one part).

    Target weights are given as a table (source, weight), or follow from the counts: n^temperature. Weights are scaled to
    sum 1; the mixture has `size` times as many documents as the input in expectation. A source without a weight in a
    given table is left out (rate 0); a null source is a source of its own. Counts combine before the shuffle.
    """
    stash = Stash(docs.sparkSession, "mixing")
    counts = stash.put(docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n_docs")))
    if weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(F.col("source").cast("string").alias("given"), F.col("weight").cast("double").alias("weight"))
        weighted = counts.join(given, F.col("source").eqNullSafe(F.col("given")), "left").select(
            "source", "n_docs", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    all_weight, all_docs = weighted.agg(F.sum("weight"), F.sum("n_docs")).first()
    if not all_weight:
        rate = F.lit(0.0)
    else:
        rate = F.col("weight") / F.lit(float(all_weight)) * F.lit(float(all_docs)) * F.lit(size) / F.col("n_docs")
    return (
        weighted.select("source", "n_docs", rate.alias("rate"))
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int"))
        .withColumn("sums", cumulative(F.col("rate") / F.col("parts")))
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 17,
    temperature: float = 0.5,
    size: float = 1.0,
    weights: DataFrame | None = None,
) -> DataFrame:
    """The mixture in shuffled order: all columns of `docs`, then __copy (from 1), __copies and __order.

    Rows are dealt out by a hash of __order and sorted by it inside each partition: a global shuffle without a sampling
    pass. Draws depend on seed, id, text and source only: repeated rows draw
    the same count, and their copies stand side by side. Null ids, texts and sources take part like any other value. An
    empty table gives no rows. Columns of any other name pass through; a column named like one of the three added is replaced.
    """
    names = [n for n in docs.columns if n not in ("__copy", "__copies", "__order")]
    stash = Stash(docs.sparkSession, "mixing")
    rates = stash.put(source_rates(docs, source, temperature, size, weights))  # read back with its size known
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("~")),
                            F.coalesce(F.col(text).cast("string"), F.lit("~"))))
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row"), key.alias("__key"),
        F.col(source).cast("string").alias("__source"),
    )
    rated = rows.join(rates.withColumnRenamed("source", "__of"), F.col("__source").eqNullSafe(F.col("__of")))

    def draw(part: Column) -> Column:
        u = uniform(F.col("__key"), part)
        # distribution values at or below u are exactly the counts that the draw has passed
        return F.size(F.filter(F.col("sums"), lambda s: s <= u))

    draws = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda total, part: total + draw(part))
    counted = rated.select("__row", "__key", draws.alias("__copies")).where("__copies > 0")
    copies = counted.select(
        "__row", "__key", "__copies", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    )
    order = F.md5(F.concat_ws("|", F.lit("order"), F.col("__key"), F.col("__copy").cast("string")))
    shuffled = copies.select("__row.*", "__copy", "__copies", order.alias("__order"))
    return shuffled.repartition("__order").sortWithinPartitions("__order")

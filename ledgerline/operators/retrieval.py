"""Rebuildable lexical projections over the ledger, and search by term coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.errors import AccessDenied, ContractError
from ledgerline.functions import Json, casefold, instant_text, stable_id
from ledgerline.operators.members import id_lists
from ledgerline.operators.scope import RequestContext, authorize
from ledgerline.session import materialize

# White space that separates words; a term never contains it.
SPACE = r"[\s\p{Z}\x1C-\x1F\x85]+"


def searchable_text() -> Column:
    """Folded "subject predicate value"."""
    return casefold(F.concat_ws(" ", "subject_key", "predicate", "value_text"))


def build_index(entries: DataFrame, projection_id: str) -> DataFrame:
    """Index rows of a projection; entries need entry_id, subject_key, predicate, value_text."""
    return entries.select(F.lit(projection_id).alias("projection_id"), "entry_id", searchable_text().alias("text"))


def build_manifest(
    entries: DataFrame,
    projection_id: str,
    implementation_version: str,
    config_digest: str,
    requested_at: Column,
    context: RequestContext,
    kind: str = "lexical",
) -> DataFrame:
    """One manifest row: how many entries, the newest observation, and their combined identity."""
    if kind != "lexical":
        raise ContractError("only lexical projections can be built")
    entries = entries.withColumn("projection_id", F.lit(projection_id))
    newest = entries.groupBy("projection_id").agg(F.max("observed_at").alias("_newest"))
    listed = id_lists(entries, ["projection_id"], ["sequence"], "entry_id")
    one = entries.sparkSession.range(1).select(F.lit(projection_id).alias("projection_id"))
    row = one.join(newest, "projection_id", "left").join(listed, "projection_id", "left")
    row = row.select(
        "projection_id",
        F.lit(kind).alias("kind"),
        F.lit(implementation_version).alias("implementation_version"),
        F.lit(config_digest).alias("config_digest"),
        F.coalesce("id_count", F.lit(0)).alias("source_entry_count"),
        F.coalesce("ids_json", F.lit("[]")).alias("source_entries"),
        F.coalesce("_newest", requested_at).alias("source_as_of"),
        F.lit("ready").alias("status"),
        requested_at.alias("recorded_at"),
        *[F.lit(v).alias(k) for k, v in context.scope().items()],
        F.lit(None).cast("string").alias("failure_reason"),
    )
    return with_manifest_id(row)


def with_manifest_id(manifests: DataFrame) -> DataFrame:
    return manifests.withColumn(
        "manifest_id",
        stable_id(
            "projection-manifest",
            F.col("projection_id"),
            F.col("kind"),
            F.col("implementation_version"),
            F.col("config_digest"),
            Json(F.col("source_entries")),
            instant_text(F.col("source_as_of")),
            F.col("status"),
            instant_text(F.col("recorded_at")),
            F.col("tenant_id"),
            F.col("project_id"),
            F.col("site_id"),
            F.col("failure_reason"),
        ),
    )


def latest_manifests(manifests: DataFrame, order: Sequence[str] = ("write_seq",)) -> DataFrame:
    """Current manifest of every projection: the last one written."""
    newest = Window.partitionBy("projection_id").orderBy(*[F.desc(c) for c in order])
    return manifests.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def next_manifest(current: DataFrame, status: str, recorded_at: Column, reason: str | None = None) -> DataFrame:
    """The manifest that a failure or deletion appends after the current one."""
    if status == "failed" and not reason:
        raise ContractError("a failed projection needs a reason")
    if status != "failed" and reason is not None:
        raise ContractError("only a failed projection has a reason")
    return with_manifest_id(
        current.drop("manifest_id")
        .withColumn("status", F.lit(status))
        .withColumn("recorded_at", recorded_at)
        .withColumn("failure_reason", F.lit(reason).cast("string"))
    )


def live_index(index: DataFrame, manifests: DataFrame) -> DataFrame:
    """Index rows of projections whose current manifest is ready."""
    ready = latest_manifests(manifests).where("status = 'ready'").select("projection_id")
    return index.join(ready, "projection_id", "left_semi")


def query_terms(query: str) -> list[str]:
    """Folded words of a query; repeated words count again."""
    return query.casefold().split()


def search(
    index: DataFrame,
    manifest: dict | None,
    query: str,
    context: RequestContext,
    limit: int = 10,
) -> DataFrame:
    """Best entries for one query: one scan, no shuffle but the final top-k.

    The checks come in this order: limit, readiness, permission, scope, terms.
    """
    if limit <= 0:
        raise ContractError("a limit is positive")
    if manifest is None or manifest["status"] != "ready":
        raise LookupError("the projection is not ready")
    if not authorize(context, "search", manifest):
        raise AccessDenied("the request is for another scope than the projection")
    terms = query_terms(query)
    matched = F.lit(0)
    for term in terms:
        matched = matched + F.col("text").contains(term).cast("int")
    score = matched.cast("double") / F.lit(float(max(len(terms), 1)))
    return (
        index.where(F.col("projection_id") == manifest["projection_id"])
        .select("entry_id", score.alias("score"), F.lit(manifest["manifest_id"]).alias("projection_manifest_id"))
        .where(F.col("score") > 0)
        .orderBy(F.desc("score"), F.asc("entry_id"))
        .limit(limit)
    )


def _grams(text: Column, width: int) -> Column:
    """Distinct substrings of a width."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - width + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(width))))


def term_matches(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, word) where the word contains the term, found by joining on shared substrings.

    A term meets only the words that share its leading piece of up to three characters; the pair
    is then checked in full, so the result is exact.
    """
    width = F.least(F.char_length("term"), F.lit(3))
    pieces = terms.select("term", F.substr(F.col("term"), F.lit(1), width).alias("piece"))
    grams = words.select(
        "word",
        F.explode(
            F.array_distinct(F.concat(*[_grams(F.col("word"), n) for n in (1, 2, 3)]))
        ).alias("piece"),
    )
    used = pieces.select("piece").distinct()
    narrowed = grams.join(used, "piece", "left_semi")
    return narrowed.join(pieces, "piece").where(F.col("word").contains(F.col("term"))).select("term", "word")


# A batch search goes through the index in the order of entry ids, in PARTS ranges: up to these ends.
PARTS = 64
ENDS = (1, 8, PARTS)


def query_weights(queries: DataFrame) -> DataFrame:
    """(query_id, term_count, term, weight) of queries (query_id, query): `weight` counts a term's repetitions in its query."""
    asked = queries.select(
        "query_id", F.filter(F.split(casefold(F.col("query")), SPACE), lambda t: t != "").alias("terms")
    ).where(F.size("terms") > 0)
    return (
        asked.select("query_id", F.size("terms").alias("term_count"), F.explode("terms").alias("term"))
        .groupBy("query_id", "term_count", "term")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def query_plan(weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """Weights with `rest`, what a term and the commoner ones of its query can add to a score.

    sizes has how many entries a term's list holds at most; terms without a size are in no entry.
    """
    common_first = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("term"))
    sized = weights.join(sizes, "term", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return sized.withColumn("rest", F.sum("weight").over(common_first)).drop("size")


def open_terms(plan: DataFrame, best: DataFrame | None, limit: int) -> DataFrame:
    """The plan with `floor` (what an entry's matched weight must exceed) and `open`: whether the term's list has to be read.

    Entries found so far have smaller ids than those to come, so an entry to come must match more than the last of a full answer. One that holds
    none of a query's rarer terms matches at most the rest; the lists of the commoner terms stay closed as soon as that is not enough.
    """
    if best is None:
        return plan.withColumns({"floor": F.lit(0).cast("bigint"), "open": F.lit(True)})
    floors = best.where(F.col("rank") == limit).select("query_id", F.col("matched").alias("floor"))
    raised = plan.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    return raised.withColumn("open", F.col("rest") > F.col("floor"))


def search_batch(index: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Top entries for many queries (query_id, query) over one projection, by posting lists and score bounds.

    Terms hold no white space, so containment in the text is containment in one of its words; distinct words are matched once, and a term's list is
    as long as its words are frequent. The index is read in ranges of entry ids. In the first, a small part of it, every list is
    open; then the scores found bound what others have to reach, rare terms' lists are read, and entries on them are tested for the
    other terms only if they can still reach the bound. A query of common terms ends with the first range in which enough entries hold
    all of them. Of entries with the same text only the first `limit` ids take part, since equal scores are ordered by id.
    """
    if limit <= 0:
        raise ContractError("a limit is positive")
    alike = Window.partitionBy("text").orderBy("entry_id")
    first_ids = index.select("text", "entry_id").withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= limit)
    ranged = first_ids.drop("_n").repartitionByRange(PARTS, "entry_id").withColumn("part", F.spark_partition_id())
    entries = materialize(ranged, "search")
    worded = entries.select("part", "entry_id", F.explode(F.array_distinct(F.split("text", SPACE))).alias("word")).where("word <> ''")
    frequency = worded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    weights = query_weights(queries)
    terms = weights.select("term").distinct()
    matches = materialize(term_matches(frequency.select("word"), terms).join(frequency, "word"), "search")
    plan = materialize(query_plan(weights, matches.groupBy("term").agg(F.sum("n").alias("size"))), "search")

    best, start = None, 0
    for end in ENDS:
        here = (F.col("part") >= start) & (F.col("part") < end)
        state = open_terms(plan, best, limit)
        opened = state.where("open").select("query_id", "term", "weight")
        read = matches.join(opened.select("term").distinct(), "term").select("term", "word")
        lists = worded.where(here).join(read, "word").select("term", "entry_id").distinct()
        seen = lists.join(opened, "term").groupBy("query_id", "entry_id").agg(F.sum("weight").alias("seen"))
        closed = F.when(~F.col("open"), F.struct("term", "weight"))
        bounds = state.groupBy("query_id", "term_count", "floor").agg(
            F.collect_list(closed).alias("closed"), F.sum(F.when(~F.col("open"), F.col("weight")).otherwise(0)).alias("more")
        )
        able = seen.join(bounds, "query_id").where(F.col("seen") + F.col("more") > F.col("floor"))
        tested = able.join(entries.where(here).select("entry_id", "text"), "entry_id")
        probe = lambda total, c: total + F.when(F.contains(F.col("text"), c["term"]), c["weight"]).otherwise(0)
        matched = tested.withColumn("matched", F.aggregate("closed", F.col("seen"), probe)).where("matched > floor")
        found = matched.select("query_id", "term_count", "entry_id", "matched")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        order = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.asc("entry_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        best = materialize(best, "search") if end < PARTS else best
        start = end
    return best.select("query_id", "entry_id", (F.col("matched") / F.col("term_count")).alias("score"), "rank")

"""Evidence-backed answers per scope: item list, keyword quantity and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import Json, decimal_text, stable_id
from ledgerline.functions.identity import quoted
from ledgerline.functions.text import normalize_question
from ledgerline.operators.bom import KEYWORD, has_keyword
from ledgerline.operators.evidence import evidence_id, pipeline_statuses, with_chain
from ledgerline.operators.members import id_lists
from ledgerline.operators.reconciliation import merge_totals, reconcile_totals
from ledgerline.operators.resolution import resolve_rows
from ledgerline.operators.scope import RequestContext, within
from ledgerline.schemas import MONEY, SCOPE
from ledgerline.session import materialize

# Claim kinds.
DISTINCT_SKUS, KEYWORD_QUANTITY, BOM_COST = "distinct_skus", "gpu_quantity", "bom_cost"

# Reasons a reviewer may give.
REVIEW_REASONS = ("wrong_result", "source_issue", "mapping_issue", "resolution_issue", "stale_result")


def sku_totals(lines: DataFrame, by: Sequence[str] = SCOPE, keyword: str = KEYWORD) -> DataFrame:
    """Per source and raw identifier: all that resolution, reconciliation and claims need.

    The first shuffle carries one combined row per identifier and map task, so a hot identifier,
    source or scope weighs no more than any other.
    """
    return lines.groupBy(*by, "artifact_id", "sku").agg(
        F.sum("quantity").alias("quantity"),
        F.min("unit_price").alias("min_price"),
        F.max("unit_price").alias("max_price"),
        F.count(F.when(F.col("unit_price").isNull(), 1)).alias("unpriced"),
        F.count(F.lit(1)).alias("line_count"),
        F.count(F.when(has_keyword(F.col("description"), keyword), 1)).alias("keyword_lines"),
    )


def reconciled_keys(
    lines: DataFrame,
    candidates: DataFrame,
    precedence: Sequence[str],
    by: Sequence[str] = SCOPE,
    keyword: str = KEYWORD,
    strict: bool = False,
    share: bool = False,
) -> DataFrame:
    """Reconciled row per key from raw lines; the null key holds what did not resolve.

    Keys that several tables start from should be shared: then the combined lines and the keys are written once.
    """
    combined = sku_totals(lines, by, keyword)
    if share:
        combined = materialize(combined, "claims")
    keys = keys_of_totals(resolve_rows(combined, candidates), precedence, by, strict)
    return materialize(keys, "claims") if share else keys


def keys_of_totals(resolved: DataFrame, precedence: Sequence[str], by: Sequence[str] = SCOPE, strict: bool = False) -> DataFrame:
    """`reconciled_keys` from resolved `sku_totals`."""
    flagged = F.sum("keyword_lines").alias("keyword_lines")
    totals = merge_totals(resolved, [*by, "canonical_key", "artifact_id"], [flagged])
    return reconcile_totals(
        totals,
        precedence,
        by,
        strict=strict,
        extra=[F.sum("line_count").alias("line_count"), flagged],
    )


def scope_summary(keys: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Counts per scope over all lines and over keyword lines, enough to decide every status."""
    known = F.col("canonical_key").isNotNull() & F.col("governing_source_artifact").isNotNull()
    flagged = F.col("keyword_lines") > 0
    conflict = known & (F.col("status") == "conflict")
    extended = (F.col("quantity") * F.col("unit_price")).cast(MONEY)

    def many(condition: Column, name: str) -> Column:
        return F.count(F.when(condition, 1)).alias(name)

    return keys.groupBy(*by).agg(
        F.sum("line_count").alias("lines"),
        F.sum("keyword_lines").alias("keyword_lines"),
        many(~known, "unresolved"),
        many(~known & flagged, "keyword_unresolved"),
        many(known, "keys"),
        many(known & flagged, "keyword_keys"),
        many(conflict, "conflicts"),
        many(conflict & flagged, "keyword_conflicts"),
        many(known & F.col("unit_price").isNull(), "unpriced_keys"),
        F.sum(F.when(known & flagged, F.col("quantity"))).alias("keyword_quantity"),
        F.sum(F.when(known, extended)).cast(MONEY).alias("cost"),
    )


def run_status() -> Column:
    """Status of a whole run over scope_summary columns."""
    return (
        F.when(F.col("keys") == 0, "unresolved").when(F.col("conflicts") > 0, "conflict").otherwise("reconciled")
    )


def _status(lines: str, unresolved: str, keys: str, conflicts: str) -> Column:
    open_ended = (F.col(unresolved) > 0) | (F.col(lines) == 0) | (F.col(keys) == 0)
    return F.when(open_ended, "unresolved").when(F.col(conflicts) > 0, "conflict").otherwise("reconciled")


def claims_from_summary(summary: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Three claim rows per scope.

    Values exist only for reconciled claims. The item list itself is `claim_keys`; here its length
    stands for it. Resolution and operational status feed the evidence chain.
    """
    everything = _status("lines", "unresolved", "keys", "conflicts")
    by_keyword = _status("keyword_lines", "keyword_unresolved", "keyword_keys", "keyword_conflicts")
    cost_status = F.when((everything == "reconciled") & (F.col("unpriced_keys") > 0), "unresolved").otherwise(
        everything
    )

    def claim(kind: str, status: Column, prefix: str, value: Column, key_count: Column) -> Column:
        lines, unresolved, keys = (F.col(prefix + name) for name in ("lines", "unresolved", "keys"))
        settled = status == "reconciled"
        trace = pipeline_statuses(lines, unresolved, keys, F.when(keys > 0, status).otherwise("unresolved"))
        return F.struct(
            F.lit(kind).alias("kind"),
            status.alias("status"),
            F.when(settled, value).cast(MONEY).alias("value"),
            F.when(settled, key_count).cast("bigint").alias("key_count"),
            lines.cast("bigint").alias("evidence_count"),
            trace[1].alias("resolution_status"),
            trace[2].alias("state_status"),
            trace[3].alias("reconciliation_status"),
        )

    none = F.lit(None)
    return summary.select(
        *by,
        F.inline(
            F.array(
                claim(DISTINCT_SKUS, everything, "", none, F.col("keys")),
                claim(KEYWORD_QUANTITY, by_keyword, "keyword_", F.col("keyword_quantity"), none),
                claim(BOM_COST, cost_status, "", F.col("cost"), none),
            )
        ),
    )


def inspect_claims(
    lines: DataFrame,
    candidates: DataFrame,
    precedence: Sequence[str],
    by: Sequence[str] = SCOPE,
    keyword: str = KEYWORD,
    scopes: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Claims of every scope; scopes listed without any line get unresolved claims."""
    summary = scope_summary(reconciled_keys(lines, candidates, precedence, by, keyword, strict), by)
    if scopes is not None:
        wanted = scopes.select(*by).distinct()
        summary = wanted.join(summary, list(by), "left")
        counted = [c for c in summary.columns if c not in (*by, "cost", "keyword_quantity")]
        summary = summary.fillna(0, subset=counted)
    return claims_from_summary(summary, by)


def claim_keys(keys: DataFrame, claims: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """Canonical keys of every reconciled item-list claim, one per row."""
    settled = claims.where((F.col("kind") == DISTINCT_SKUS) & (F.col("status") == "reconciled")).select(*by)
    return keys.where(F.col("canonical_key").isNotNull()).join(settled, list(by), "left_semi").select(
        *by, "canonical_key"
    )


def claim_evidence(lines: DataFrame, by: Sequence[str] = SCOPE, keyword: str = KEYWORD) -> DataFrame:
    """Source lines behind each claim kind; every claim cites only its own lines."""
    hit = has_keyword(F.col("description"), keyword)
    subsets = F.array(F.lit("lines"), F.when(hit, "keyword_lines"))
    return lines.select(
        *by,
        "line_no",
        evidence_id(lines.columns).alias("evidence_id"),
        F.explode(F.filter(subsets, lambda s: s.isNotNull())).alias("subset"),
    )


def _printed_keys(ids: Column) -> Column:
    """Item list in the printed form that enters claim identifiers."""
    listed = F.array_join(F.transform(ids, quoted), ", ")
    return F.concat(F.lit("("), listed, F.when(F.size(ids) == 1, ",").otherwise(""), F.lit(")"))


def _subset() -> Column:
    """Which lines a claim cites, as `claim_evidence` names them."""
    return F.when(F.col("kind") == KEYWORD_QUANTITY, "keyword_lines").otherwise("lines")


def claim_ids(
    claims: DataFrame,
    evidence: DataFrame,
    key_rows: DataFrame,
    by: Sequence[str] = SCOPE,
) -> DataFrame:
    """Attach chain and claim identifiers to claims; `entries` stand for their evidence lists (see `members`)."""
    lists = id_lists(evidence, [*by, "subset"], ["line_no"])
    keys = id_lists(key_rows, by, ["canonical_key"], "canonical_key")
    keys = keys.select(
        *by,
        F.lit(DISTINCT_SKUS).alias("kind"),
        _printed_keys(F.col("entries")).alias("_keys"),
    )
    joined = (
        claims.withColumn("subset", _subset())
        .join(keys, [*by, "kind"], "left")
        .join(lists, [*by, "subset"], "left")
        .withColumn("ids_json", F.coalesce("ids_json", F.lit("[]")))
    )
    statuses = [F.lit("observed"), *[F.col(f"{s}_status") for s in ("resolution", "state", "reconciliation")]]
    chained = with_chain(joined, F.col("kind"), statuses)
    value = F.coalesce(decimal_text(F.col("value")), F.col("_keys"), F.lit("None"))
    return chained.withColumn(
        "claim_id",
        stable_id("claim", F.col("kind"), value, F.col("status"), F.col("chain_id"), Json(F.col("ids_json"))),
    ).drop("_keys", "subset", "id_count")


def review_context(
    claims_with_ids: DataFrame, by: Sequence[str] = SCOPE, context: RequestContext | None = None
) -> DataFrame:
    """What a reviewer sees of a claim; filter by claim_id to pick one.

    A request context needs the review permission, and sees the claims of its scope only.

    `evidence_entries` stands for the whole list in at most `members.FANOUT` entries; `review_evidence` has the list as rows.
    """
    if context is not None:
        claims_with_ids = within(claims_with_ids, context, "review")
    return claims_with_ids.select(
        *by,
        "claim_id",
        F.col("kind").alias("claim_kind"),
        F.col("value").alias("claim_value"),
        F.col("status").alias("claim_status"),
        "evidence_count",
        F.coalesce("entries", F.array().cast("array<string>")).alias("evidence_entries"),
        "chain_id",
        F.col("nodes.node_id").alias("node_ids"),
        F.array(*[F.lit(reason) for reason in REVIEW_REASONS]).alias("allowed_reasons"),
    )


def review_evidence(claims_with_ids: DataFrame, evidence: DataFrame, by: Sequence[str] = SCOPE) -> DataFrame:
    """One row per claim and line it cites, however many there are; evidence as `claim_evidence` makes it.

    Identifiers are written once, so that what made them is off the disk before the evidence is dealt out.
    """
    cited = materialize(claims_with_ids.withColumn("subset", _subset()).select(*by, "subset", "claim_id"), "review")
    return evidence.join(cited, [*by, "subset"]).select(*by, "claim_id", "line_no", "evidence_id")


# Words that route a question, in order of precedence.
QUANTITY_WORDS = ("how many", "quantity")
COST_WORDS = ("cost", "price", "total")
ITEM_WORDS = ("sku",)


def route(question: Column, keyword: str = KEYWORD) -> Column:
    """Claim kind a normalized question asks for; null when no route is approved."""

    def any_of(words: Sequence[str]) -> Column:
        hit = question.contains(words[0])
        for word in words[1:]:
            hit = hit | question.contains(word)
        return hit

    return (
        F.when(question.contains(keyword) & any_of(QUANTITY_WORDS), KEYWORD_QUANTITY)
        .when(any_of(COST_WORDS), BOM_COST)
        .when(any_of(ITEM_WORDS), DISTINCT_SKUS)
    )


def answer_questions(
    questions: DataFrame, claims: DataFrame, by: Sequence[str] = SCOPE, keyword: str = KEYWORD
) -> DataFrame:
    """Route free-text questions and attach the claim of their scope; unsupported ones stay visible."""
    routed = questions.withColumn("kind", route(normalize_question(F.col("question")), keyword))
    answers = claims.select(*by, "kind", F.col("status").alias("claim_status"), "value", "key_count")
    return routed.join(answers, [*by, "kind"], "left").withColumn(
        "route_status", F.when(F.col("kind").isNull(), "unsupported").otherwise("routed")
    )

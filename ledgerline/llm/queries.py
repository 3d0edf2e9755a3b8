"""The queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import chat, embeddings, lines, mixing, negatives, packing, pieces, quality, simhash, structure, suffixes, topk, toxicity
from ledgerline.llm.common import Stash, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if check is not None:
            ORACLES[name] = check
        return run

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id",
        (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keep_fp"))).alias("kept"),
    )


CHAT_TEXT = "\\### Assistant: </turn> ok"


@query(
    "op7_chat_formatting",
    r"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    length(replace(replace(replace(coalesce(role, ''), '\', '\\'), '###', '\h'), '</turn>', '\e'))
    + length(replace(replace(replace(coalesce(text, ''), '\', '\\'), '###', '\h'), '</turn>', '\e'))
    + length('### ') + length(' ###') + 1 + length('</turn>') + 1 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_TEXT).alias("text"),
    )
    chunks = chat.render(chat.rebuild(chat.to_events(given.union(planted))))
    read = chat.parse(chunks)
    turn = F.struct("message", "role", "text", "learned", "chars")
    turns = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join(F.transform("turns", lambda t: t["learned"]), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["chars"]).alias("formatted_chars"),
    )


@query(
    "op8_mixing",
    """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n_docs, pow(CAST(count(*) AS DOUBLE), 0.5) AS weight FROM documents GROUP BY source
), rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM counts) * CAST((SELECT sum(n_docs) FROM counts) AS DOUBLE) / n_docs AS rate
  FROM counts
), split AS (
  SELECT source, greatest(1, CAST(ceil(rate / 16.0) AS INTEGER)) AS parts, rate / greatest(1, ceil(rate / 16.0)) AS mean FROM rates
), poisson AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS total,
    CAST(ceil(mean + 12 * sqrt(mean) + 20) AS INTEGER) AS last FROM split
  UNION ALL
  SELECT source, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1), last FROM poisson WHERE k < last
), keyed AS (
  SELECT doc_id, source, text, md5('17' || '|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || coalesce(text, '~')) AS key
  FROM documents
), drawn AS (
  SELECT doc_id, keyed.source, text, key,
    CAST('0x' || substr(md5(key || '|' || CAST(part AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM keyed JOIN split ON keyed.source IS NOT DISTINCT FROM split.source, generate_series(1, parts) AS s(part)
), counted AS (
  SELECT doc_id, d.source, text, key, count(*) AS copies
  FROM drawn d JOIN poisson p ON d.source IS NOT DISTINCT FROM p.source AND p.total <= d.u GROUP BY ALL
)
SELECT doc_id, source, text, CAST(copy AS BIGINT) AS copy, copies,
  md5('order' || '|' || key || '|' || CAST(copy AS VARCHAR)) AS order_key
FROM counted, generate_series(1, copies) AS c(copy)
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", "text", F.col("__copy").cast("long").alias("copy"),
        F.col("__copies").cast("long").alias("copies"), F.col("__order").alias("order_key"),
    )


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 0.5)


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels"))), quality.THRESHOLD)


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduplicated = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduplicated.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__kept").alias("n_kept"), "text")


@query("op1_embedding_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op2_exact_topk",
    """
WITH coded AS (
  SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.key, q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
  FROM coded q JOIN coded v ON q.key <> v.key AND len(q.c) = len(v.c) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_sentencepiece")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    decoded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query(
    "op12_structure_repair",
    r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), hit AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ), 4294967295) % 20 AS h
  FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, (VALUES (1), (2)) AS c(copy) WHERE h <> 0 AND (copy = 1 OR h = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), marked AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE
      WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), inserts(s, t, n, roles) AS (
  VALUES (0, 0, 0, ''), (0, 2, 1, chr(10) || 'user:'), (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 1, 0, ''), (1, 2, 1, chr(10) || 'user:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
    (2, 2, 0, ''), (2, 3, 1, chr(10) || 'assistant:'), (3, 3, 0, ''), (3, 2, 1, chr(10) || 'user:')
), edits(s, t, edit, initial, role, cost) AS (
  VALUES (0, 0, 'D', '', '', 4), (1, 1, 'D', '', '', 4), (2, 2, 'D', '', '', 4), (3, 3, 'D', '', '', 4),
    (0, 2, 'R', '', 'user', 3), (1, 2, 'R', '', 'user', 3), (2, 3, 'R', '', 'assistant', 3), (3, 2, 'R', '', 'user', 3),
    (0, 1, 'K', 's', '', 0), (0, 2, 'K', 'u', '', 0), (1, 2, 'K', 'u', '', 0), (2, 3, 'K', 'a', '', 0), (3, 2, 'K', 'u', '', 0)
), fold(conv_id, i, s, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, struct_pack(c := CAST(0 AS BIGINT), a := '', r := '') FROM marked
  UNION ALL
  SELECT f.conv_id, f.i + 1, e.t, min(struct_pack(
      c := f.best.c + 3 * n.n + e.cost + CASE WHEN m.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END,
      a := f.best.a || repeat('I', n.n) || e.edit,
      r := f.best.r || n.roles || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || m.role || ':' || m.text ELSE chr(10) || e.role || ':' || m.text END))
  FROM fold f JOIN marked m ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = f.i + 1
  JOIN inserts n ON n.s = f.s
  JOIN edits e ON e.s = n.t AND (e.edit <> 'K' OR e.initial = m.initial) AND (e.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate'))
  GROUP BY f.conv_id, f.i + 1, e.t
), ended AS (
  SELECT f.conv_id, min(struct_pack(c := f.best.c + 3 * n.n, a := f.best.a || repeat('I', n.n), r := f.best.r || n.roles)) AS best
  FROM fold f JOIN (SELECT conv_id, max(i) AS i FROM marked GROUP BY conv_id) l ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i
  JOIN inserts n ON n.s = f.s AND n.t IN (0, 3) GROUP BY f.conv_id
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated
  FROM marked GROUP BY conv_id
), adjacent AS (
  SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS two FROM marked
), illegal AS (
  SELECT conv_id, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM adjacent GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums ON o.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN illegal ON o.conv_id IS NOT DISTINCT FROM illegal.conv_id
LEFT JOIN ended ON o.conv_id IS NOT DISTINCT FROM ended.conv_id
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    edited, pieces_ = structure.repair(structure.damage(given))
    edited = Stash(spark, "structure").put(edited)
    faults = edited.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    costs = pieces_.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    out = given.select("conv_id").distinct()
    for more in (faults, costs, structure.digests(edited)):
        more = more.withColumnRenamed("conv_id", "same")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("same")), "left").drop("same")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query(
    "op13_hard_negatives",
    """
WITH coded AS (
  SELECT row_number() OVER () AS key, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.key, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score
  FROM coded a JOIN coded b ON a.key <> b.key AND len(a.c) = len(b.c) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id NULLS LAST) AS place FROM pairs WHERE same
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.key, p.place ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank
  FROM positives p JOIN pairs n ON p.key = n.key AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, shifted)

"""Chat formatting from event logs: reconstruction of final messages, then a reversible template with a loss mask.

A log has one row per event: (conv_id, seq, message, kind, role, text). `message` is the place of a message in its conversation, of any type that sorts.
Kinds: `open` starts a message (and carries its role), `delta` appends text, `edit` replaces the text so far by its own text,
`regenerate` discards the text so far. Events of a message are folded in the order of seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARK = "###"
END = "</turn>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Hides control strings: backslash, then the two marks, each become a backslash pair that the template never writes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(MARK), F.lit("\\h"))
    return F.replace(out, F.lit(END), F.lit("\\e"))


def unescape(text: Column) -> Column:
    """Inverse of `escape`: pairs of backslashes are taken from the left, so what stands between them holds only the marks' pairs."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(
        parts, lambda p: F.replace(F.replace(p, F.lit("\\h"), F.lit(MARK)), F.lit("\\e"), F.lit(END))
    )
    return F.array_join(plain, "\\")


def rebuild(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log.

    Only events from the last edit or regeneration on count. Rows of a message meet in one group, conversations of any number of messages spread.
    Nulls: a null kind counts as delta, a null text as empty, a null role as unset (the last role set stands, empty if none),
    null conversations and messages form groups of their own, a null seq sorts first. Equal seq: ties go by kind, then text, so
    repeated rows fold the same way in every run. A message without an `open` event exists all the same.
    """
    rows = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), "message",
        F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"),
        "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    rank = F.row_number().over(W.partitionBy("conv_id", "message").orderBy(F.asc_nulls_first("seq"), "kind", "role", "text"))
    ranked = rows.withColumn("n", rank)
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("n"))).over(W.partitionBy("conv_id", "message"))
    folded = ranked.withColumn("reset", F.coalesce(reset, F.lit(0)))
    piece = F.when((F.col("n") >= F.col("reset")) & (F.col("kind") != "regenerate"), F.struct("n", "text"))
    return folded.groupBy("conv_id", "message").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("n"))), F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One formatted piece per message: conv_id, message, chunk, loss_start, loss_length (code points in the chunk; 0 long if masked).

    A conversation's formatted text is its chunks in the order of `message`. Any role and text, empty ones too, can be read back.
    """
    head = F.concat(F.lit(f"{MARK} "), escape(F.coalesce("role", F.lit(""))), F.lit(f" {MARK}\n"))
    body = escape(F.coalesce("text", F.lit("")))
    learned = F.col("role") == LEARNED
    return messages.select(
        "conv_id", "message", F.concat(head, body, F.lit(f"{END}\n")).alias("chunk"),
        F.char_length(head).cast("long").alias("loss_start"),
        F.when(learned, F.char_length(body)).otherwise(0).cast("long").alias("loss_length"),
    )


def parse(chunks: DataFrame) -> DataFrame:
    """Roles, texts and learned texts read back from formatted chunks alone."""
    end = F.char_length("chunk") - len(END) - 1
    cut = F.instr(F.col("chunk"), f" {MARK}\n")
    role = F.substring(F.col("chunk"), F.lit(len(MARK) + 2), cut - F.lit(len(MARK) + 2))
    start = cut + F.lit(len(MARK) + 2)
    return chunks.select(
        "conv_id", "message", F.char_length("chunk").cast("long").alias("chars"),
        unescape(role).alias("role"), unescape(F.substring(F.col("chunk"), start, end - start + 1)).alias("text"),
        unescape(F.substring(F.col("chunk"), F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int"))).alias("learned"),
    )


def to_events(conversations: DataFrame) -> DataFrame:
    """A log of finished conversations: each row opens its message and streams its text as one delta.

    Rows that share conversation and turn stay messages of their own, ordered by role and text.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    shared = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    placed = rows.withColumn("message", F.struct("turn", F.row_number().over(shared).alias("n")))
    event = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("open").alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text")),
    )
    return placed.select("conv_id", "message", F.explode(event).alias("event")).select("conv_id", "message", "event.*")

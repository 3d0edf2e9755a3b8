"""Repair of conversation structure by iterative-deepening A*.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`. Every message is kept, given another role or deleted, and
empty messages may be inserted. The search goes depth first through the edits in ASCII order (Delete, Insert, Keep, Rerole) under a bound on the
cost, and raises the bound to the least cost that it could not exclude; a table of failed states holds what is proven about the cost
from a state on. The first accepting path under the first bound that admits one is the cheapest and, of equals, the least string.

Messages are ordered by range partitions, so that a long conversation spreads over tasks, and searched in segments of at most `SEGMENT`
messages. A conversation within one segment takes one search. For a longer one, searches give the cost between the states at the ends of each segment,
a fold from its end gives the cost that remains after each segment, and searches with these as goals give the edits; only small
numbers of a conversation meet in one task, and one after the other. In all but the last segment inserts stand before a message, so that every path has
one place to be cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import Stash, arrow_batches

SEGMENT = 64
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 4, 3, 0, 3, 3
INFINITE = 1 << 60
# States by what was read last: nothing, system, user, assistant.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
KEPT = {(START, "s"): 1, (START, "u"): 2, (AFTER_SYSTEM, "u"): 2, (AFTER_ASSISTANT, "u"): 2, (AFTER_USER, "a"): 3}
# An inserted or changed role is the one that may come next.
FORCED = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
ENDS = (0, INFINITE, INFINITE, 0)
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\f\r"


def least(role: str, mark: str) -> int:
    """The least that a message costs in any conversation."""
    if mark == "-":
        return DELETE
    return min(DELETE, (KEEP if role in "sua" else REROLE) + (TRUNCATED if mark == "!" else 0))


class Search:
    """Searches through one segment, from any state before it, for the least cost to a state after it plus what the goals say that remains.

    roles has s, u, a or o (other) per message; marks has - (must go), ! (truncated) or a dot. goals has the cost that remains for each state at the
    end. Inserts at the very end are possible only in the last segment.
    """

    def __init__(self, roles: str, marks: str, goals: Sequence[int], last: bool) -> None:
        n = len(roles)
        self.end = 4 * n
        self.goals = goals
        # deleting everything and inserting a pair reaches whatever can be reached, or one message stays on the way
        self.most = DELETE * n + TRUNCATED + 2 * INSERT + max([g for g in goals if g < INFINITE], default=0)
        # what is proven about the cost from a node (four a message, one per state) on: at first the least that its messages can cost
        self.low = [min(goals)] * 4 * (n + 1)
        self.moves: list[list[tuple[int, int, str, str]]] = []
        for i in range(n - 1, -1, -1):
            self.low[4 * i : 4 * i + 4] = [self.low[4 * i + 4] + least(roles[i], marks[i])] * 4
        for i in range(n + 1):
            for state in range(4):
                self.moves.append(self._moves(i, state, roles[i : i + 1], marks[i : i + 1], i < n or last))

    @staticmethod
    def _moves(i: int, state: int, role: str, mark: str, may_insert: bool) -> list[tuple[int, int, str, str]]:
        """(cost, next node, edit, role made) in ASCII order of the edits."""
        made, then = "ua"[FORCED[state] - AFTER_USER], FORCED[state]
        out = [(DELETE, 4 * i + 4 + state, "D", ".")] if role else []
        if may_insert:
            out.append((INSERT, 4 * i + then, "I", made))
        if role and mark != "-":
            more = TRUNCATED if mark == "!" else 0
            if (state, role) in KEPT:
                out.append((KEEP + more, 4 * i + 4 + KEPT[state, role], "K", "."))
            out.append((REROLE + more, 4 * i + 4 + then, "R", made))
        return out

    def deepen(self, entry: int, bound: int) -> list[tuple[int, int, str, str]] | None:
        """The first path in ASCII order that costs at most the bound; if there is none, the table has learned."""
        low, moves, end, goals = self.low, self.moves, self.end, self.goals
        path: list[tuple[int, int, str, str]] = []
        nodes, lefts, todos = [entry], [bound], [None]
        while nodes:
            node, left, todo = nodes[-1], lefts[-1], todos[-1]
            if todo is None:
                if node >= end and goals[node - end] <= left:
                    return path
                todo = todos[-1] = iter(moves[node])
            for move in todo:
                if move[0] + low[move[1]] <= left:
                    path.append(move)
                    nodes.append(move[1])
                    lefts.append(left - move[0])
                    todos.append(None)
                    break
            else:
                proven = min([move[0] + low[move[1]] for move in moves[node]], default=INFINITE)
                if node >= end:
                    proven = min(proven, goals[node - end])
                low[node] = max(low[node], proven)
                nodes.pop(), lefts.pop(), todos.pop()
                if path:
                    path.pop()
        return None

    def run(self, entry: int) -> tuple[int, str, str, int] | None:
        """Cost, edits, the roles they make (a dot where none) and the state at the end, or None if no goal can be reached."""
        while (bound := self.low[entry]) <= self.most:
            path = self.deepen(entry, bound)
            if path is not None:
                state = path[-1][1] % 4 if path else entry
                return bound - self.goals[state], "".join(m[2] for m in path), "".join(m[3] for m in path), state
        return None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _written(rows: Iterator[dict], fields: str, size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows as batches, under a schema in Spark's words."""
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    names = [field.split() for field in fields.split(", ")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in names])
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, function: Callable[[Iterator[dict]], Iterator[dict]], fields: str) -> DataFrame:
    return arrow_batches(df, lambda batches: _written(function(_rows(batches)), fields), fields)


SEGMENTS = "conv_id long, chunk long, roles string, marks string, first int, last int"
COSTS = SEGMENTS + ", costs array<long>"
GOALS = SEGMENTS + ", goals array<long>"
CHOICES = "conv_id long, chunk long, roles string, cost array<long>, edits array<string>, made array<string>, ends array<int>"
SOLVED = "conv_id long, chunk long, cost long, illegal long, edits string, made string"


def _between(rows: Iterator[dict]) -> Iterator[dict]:
    """Costs of a segment from each state (and to each, unless it is the last)."""
    for row in rows:
        ways = [ENDS] if row["last"] else [[0 if t == end else INFINITE for t in range(4)] for end in range(4)]
        searches = [Search(row["roles"], row["marks"], goals, bool(row["last"])) for goals in ways]
        found = [one.run(entry) for entry in range(4) for one in searches]
        yield row | {"costs": [INFINITE if f is None else f[0] for f in found]}


def _remaining(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows of a conversation come from its last segment to its first; each gets the costs that remain after it."""
    for _, segments in groupby(rows, lambda row: row["conv_id"]):
        after: list[int] = list(ENDS)
        for row in segments:
            costs = row.pop("costs")
            yield row | {"goals": after}
            if row["last"]:
                after = costs
            else:
                after = [min(INFINITE, *(costs[4 * s + t] + after[t] for t in range(4))) for s in range(4)]


def _solved(rows: Iterator[dict]) -> Iterator[dict]:
    """Edits of a segment for each state before it."""
    for row in rows:
        one = Search(row["roles"], row["marks"], row["goals"], bool(row["last"]))
        found = [one.run(s) if s == START or not row["first"] else None for s in range(4)]
        told = [f or (INFINITE, "", "", s) for s, f in enumerate(found)]
        columns = {name: [t[k] for t in told] for k, name in enumerate(("cost", "edits", "made", "ends"))}
        yield {name: row[name] for name in ("conv_id", "chunk", "roles")} | columns


def _chosen(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows of a conversation in order; each gets the edits for the state that the one before ends with."""
    for _, segments in groupby(rows, lambda row: row["conv_id"]):
        state, before = START, ""
        for row in segments:
            told = before + row["roles"]
            illegal = sum(told[i : i + 2] not in LEGAL for i in range(len(told) - 1))
            yield {"conv_id": row["conv_id"], "chunk": row["chunk"], "cost": row["cost"][state], "illegal": illegal, "edits": row["edits"][state], "made": row["made"][state]}
            state, before = row["ends"][state], row["roles"][-1]


def _whole(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        cost, edits, made, _ = Search(row["roles"], row["marks"], ENDS, True).run(START)
        told = row["roles"]
        illegal = sum(told[i : i + 2] not in LEGAL for i in range(len(told) - 1))
        yield {"conv_id": row["conv_id"], "chunk": row["chunk"], "cost": cost, "illegal": illegal, "edits": edits, "made": made}


def fault(text: Column, again: Column) -> Column:
    """blank, duplicate (`again`: role and text came before), truncated, or null: the first that holds."""
    end = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    return (
        F.when(F.length(F.trim(text, F.lit(WHITE))) == 0, "blank")
        .when(again, "duplicate")
        .when(~end.isin(".", "!", "?"), "truncated")
    )


def repair(messages: DataFrame, segment: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edits per message, and the sums of each piece of a conversation.

    messages: conv_id, turn, role, text; null roles and texts count as one space. The first result has a row per message: conv_id, place (orders all
    messages), turn, role, text, fault, edits (inserts before the message, then its own edit; after the last message of a conversation inserts may follow) and
    made (per edit the role it makes, u or a, or a dot). The second has conv_id, cost and illegal (adjacent roles that don't fit) per piece.

    Messages are ordered by turn (nulls first), then role and a hash of the text; equal rows count one by one, and all but the first are duplicates. A
    null conversation is one of its own. Roles count by their first character; empty and other ones fit nowhere. Texts may be of any length; an empty table gives no rows, and
    further columns are not read.
    """
    spark = messages.sparkSession
    stash = Stash(spark, "structure")
    size = segment or SEGMENT
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumns({"digest": F.sha2("text", 256), "salt": F.monotonically_increasing_id()})  # equal rows, too, can be split
    order = ["conv_id", "turn", "role", "digest", "salt"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ordered = stash.put(ordered.drop("salt"))

    firsts = ordered.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    initial = F.substring("role", 1, 1)
    flags = ordered.select(
        "conv_id", "place", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("letter"),
        fault(F.col("text"), F.lit(False)).alias("seen"),
    )
    flagged = flags.join(firsts, "place", "left").select(
        "conv_id", "place", "letter", F.when(F.col("new").isNull() & (F.coalesce("seen", F.lit("")) != "blank"), "duplicate").otherwise(F.col("seen")).alias("fault"),
    )
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", "!").otherwise(".")
    flagged = stash.put(flagged.withColumn("mark", mark))
    # a chunk is a run of places of one partition, so a conversation's part of it is bounded
    listed = flagged.groupBy("conv_id", F.floor(F.col("place") / size).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("place", "letter", "mark"))).alias("all")
    )
    whole = W.partitionBy("conv_id")
    segments = stash.put(listed.select(
        "conv_id", "chunk", F.array_join(F.transform("all", lambda m: m["letter"]), "").alias("roles"),
        F.array_join(F.transform("all", lambda m: m["mark"]), "").alias("marks"),
        (F.col("chunk") == F.min("chunk").over(whole)).cast("int").alias("first"), (F.col("chunk") == F.max("chunk").over(whole)).cast("int").alias("last"),
        F.col("all")[0]["place"].alias("place"),
    ))
    short = segments.where("first = 1 AND last = 1").drop("place")
    long = segments.where("first = 0 OR last = 0").drop("place")
    by_end = _mapped(long, _between, COSTS).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"))
    choices = _mapped(_mapped(by_end, _remaining, GOALS).repartition("conv_id", "chunk"), _solved, CHOICES)
    picked = _mapped(choices.repartition("conv_id").sortWithinPartitions("conv_id", "chunk"), _chosen, SOLVED)
    solved = stash.put(_mapped(short, _whole, SOLVED).union(picked))

    # an edit string is cut after each message's own edit; inserts at the very end go with the last message
    part = F.regexp_extract_all("edits", F.lit("I*[DKR](?:I+$)?"), F.lit(0))
    cut = solved.select("conv_id", "chunk", "made", part.alias("parts")).join(
        segments.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "place"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))
    )
    ends = F.transform("parts", lambda p, i: F.aggregate(F.slice("parts", 1, i + 1), F.lit(0), lambda n, q: n + F.length(q)))
    spread = cut.withColumn("ends", ends).select("place", "made", "ends", F.posexplode("parts").alias("at", "edits"))
    edits = spread.select(
        (F.col("place") + F.col("at")).alias("place"), "edits",
        F.substring(F.col("made"), F.col("ends")[F.col("at")] - F.length("edits") + 1, F.length("edits")).alias("made"),
    )
    told = ordered.drop("digest").join(flagged.select("place", "fault"), "place").join(edits, "place")
    return told.select("conv_id", "place", "turn", "role", "text", "fault", "edits", "made"), solved.select("conv_id", "cost", "illegal")


def repaired(edited: DataFrame) -> DataFrame:
    """The messages after the edits: conv_id, place, part (of a place), role, text."""
    each = F.transform(F.sequence(F.lit(1), F.length("edits")), lambda i: F.struct(
        i.alias("part"), F.substring(F.col("edits"), i, F.lit(1)).alias("edit"), F.substring(F.col("made"), i, F.lit(1)).alias("made"),
    ))
    one = edited.withColumn("e", F.explode(each)).where("e.edit <> 'D'")
    role = F.when(F.col("e.made") == "u", "user").when(F.col("e.made") == "a", "assistant").otherwise(F.col("role"))
    text = F.when(F.col("e.edit") == "I", "").otherwise(F.col("text"))
    return one.select("conv_id", "place", "e.part", role.alias("role"), text.alias("text"))


DIGEST = "conv_id long, audit string, repaired_sha256 string"


def digests(edited: DataFrame) -> DataFrame:
    """Per conversation its edits in order, and the digest of its repaired `role:text` messages, joined by newlines.

    A digest needs its messages one after the other: a task streams the sorted rows and holds one at a time besides the edits.
    """
    import hashlib

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for conv_id, messages in groupby(rows, lambda row: row["conv_id"]):
            digest, audit, before = hashlib.sha256(), [], b""
            for row in messages:
                audit.append(row["edits"])
                for edit, made in zip(row["edits"], row["made"], strict=True):
                    if edit != "D":
                        role = {"u": "user", "a": "assistant"}.get(made, row["role"])
                        digest.update(before + f"{role}:{'' if edit == 'I' else row['text']}".encode())
                        before = b"\n"
            yield {"conv_id": conv_id, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    narrow = edited.select("conv_id", "place", "role", "text", "edits", "made")
    return _mapped(narrow.repartition("conv_id").sortWithinPartitions("conv_id", "place"), run, DIGEST)


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with faults: crc32 of `conv_id:turn` modulo 20 drops a message (0), empties its text (1), takes its full stops away (2), repeats it (3) or
    makes it a user's (4). Nulls become one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("h"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("h <> 0").select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")

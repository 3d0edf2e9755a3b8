"""Structure repair against every edit string of small conversations."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import structure
from ledgerline.llm.queries import QUERIES, table
from ledgerline.llm.structure import ENDS, START, Search

WHITE = " \t\n\x0b\f\r"


def letter(role):
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        text_, key = text.strip(WHITE), (role, text)
        out.append("blank" if not text_ else "duplicate" if key in seen else "truncated" if text_[-1] not in ".!?" else None)
        seen.add(key)
    return out


def plain(rows):
    """Cost, audit and repaired messages: all edit strings in the order of cost, then of ASCII, without bounds or tables."""
    faults = faults_of(rows)
    heap = [(0, "", 0, ())]
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(letter(role) for role, _ in out)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, out
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            more = 3 if faults[i] == "truncated" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if faults[i] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, rows[i])))
                for role in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*out, (role, rows[i][1]))))


def some_rows(rng, most):
    roles = ["system", "user", "assistant", "tool", "", " ", "user", "assistant"]
    return [(rng.choice(roles), rng.choice(["a.", "b", "c!", "", "d. ", "e?", "\v"])) for _ in range(rng.randint(0, most))]


def test_search_finds_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(800):
        rows = some_rows(rng, 6)
        cost, audit, out = plain(rows)
        roles = "".join(letter(r) for r, _ in rows)
        marks = "".join({"blank": "-", "duplicate": "-", "truncated": "!", None: "."}[f] for f in faults_of(rows))
        assert Search(roles, marks, ENDS, True).run(START)[:2] == (cost, audit)


def test_unreachable_goals_end():
    assert Search("ua", "..", (0, structure.INFINITE, structure.INFINITE, structure.INFINITE), False).run(2) is None


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn, (role, text) in enumerate(some_rows(rng, 6)):
            rows.append((conv if conv else None, turn if turn else None, role, text))
    return rows


@pytest.mark.parametrize("segment", [1, 2, 3, 64])
def test_repair_in_segments(spark, conversations, segment):
    """Whatever the cuts are, edits equal those of whole conversations; nulls, extra columns and repeated rows included."""
    frame = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    edited, sums = structure.repair(frame, segment)
    cost = {}
    for row in sums.collect():
        cost[row.conv_id] = cost.get(row.conv_id, 0) + row.cost
    found, repaired = {}, {}
    for row in sorted(edited.collect(), key=lambda r: r.place):
        found.setdefault(row.conv_id, []).append((row.role, row.text, row.fault, row.edits))
    for row in sorted(structure.repaired(edited).collect(), key=lambda r: (r.place, r.part)):
        repaired.setdefault(row.conv_id, []).append((row.role, row.text))
    digests = {r.conv_id: (r.audit, r.repaired_sha256) for r in structure.digests(edited).collect()}
    given = {}
    for conv, _, role, text in conversations:
        given.setdefault(conv, []).append((role, text))
    assert set(found) == set(given)
    for conv, rows in given.items():
        want, audit, out = plain(rows)
        assert [f[:3] for f in found[conv]] == [(*r, f) for r, f in zip(rows, faults_of(rows), strict=True)]
        assert (cost[conv], "".join(f[3] for f in found[conv])) == (want, audit)
        assert repaired.get(conv, []) == list(out)
        assert digests[conv] == (audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def test_a_very_long_conversation(spark):
    """Segments of it are searched apart; the result costs what a plain dynamic programme says."""
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"t{i}" + rng.choice([".", ".", ".", ""])) for i in range(700)]
    edited, sums = structure.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    best = {0: 0, 1: 10**9, 2: 10**9, 3: 10**9}
    inserts = [(0, 2, 3), (0, 3, 6), (1, 2, 3), (1, 3, 6), (2, 3, 3), (3, 2, 3)]
    for _, _, role, text in rows:
        more = 0 if text.endswith(".") else 3
        before = {t: min([best[t], *(best[s] + c for s, e, c in inserts if e == t)]) for t in range(4)}
        after = {t: before[t] + 4 for t in range(4)}
        for s in range(4):
            to = 3 if s == 2 else 2
            after[to] = min(after[to], before[s] + 3 + more)
            if (kept := structure.KEPT.get((s, role[0]))) is not None:
                after[kept] = min(after[kept], before[s] + more)
        best = after
    want = min(best[0], best[3], best[0] + 6, best[1] + 6, best[2] + 3)
    assert sum(r.cost for r in sums.collect()) == want
    initials = "".join(r.role[0] for r in sorted(structure.repaired(edited).collect(), key=lambda r: (r.place, r.part)))
    assert re.fullmatch("(s?(ua)+)?", initials)


def test_empty_and_null_rows(spark):
    frame = spark.createDataFrame([(None, None, None, None), (3, 0, "user", "x" * 200_000 + ".")], "conv_id long, turn long, role string, text string")
    edited, _ = structure.repair(frame)
    assert {r.conv_id: (r.fault, r.edits) for r in edited.collect()} == {None: ("blank", "D"), 3: (None, "KI")}
    for part in structure.repair(frame.limit(0)):
        assert part.count() == 0


def test_query_keeps_every_conversation(spark, sf_dir):
    """Damage by a plain version, conversation by conversation."""
    rows = table(spark, sf_dir, "conversations").collect()
    given = {r.conv_id: [] for r in rows}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        h = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", r.text) if h == 2 else r.text
        given[r.conv_id] += [("user" if h == 4 else r.role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    found = {r.conv_id: r for r in QUERIES["op12_structure_repair"](spark, sf_dir).collect()}
    assert set(found) == set(given)
    for conv, turns in given.items():
        cost, audit, out = plain(turns)
        assert (found[conv].cost, found[conv].audit) == (cost, audit)
        assert found[conv].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()

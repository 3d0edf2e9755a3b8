"""Training-text operators against plain versions, with nulls, empties, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from compare import connect, differences
from ledgerline.llm import chat, common, embeddings, lines, mixing, packing, quality, simhash, suffixes, topk, toxicity
from ledgerline.llm.common import components
from ledgerline.llm.queries import ORACLES, QUERIES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [words(rng, 60) for _ in range(12)]
    near = [t.replace(t.split()[30], "changed", 1) for t in base[:4]]
    passage = words(rng, 30)
    rows = [(i, t) for i, t in enumerate(base + base[:3] + near)]
    rows += [(40, passage + "\n" + words(rng, 40)), (41, words(rng, 9) + "\n" + passage), (42, ""), (43, None), (44, "  "), (45, "one two")]
    rows += [(None, base[0]), (None, None), (7, base[7]), (46, "x" * 500), (47, "x" * 80), (48, words(rng, 4000)), (49, "\n" * 30)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, None, 1, 2.0) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- components -------------------------------------------------------------------------------------------------


def reach(edges, nodes):
    low = {n: n for n in nodes}
    while True:
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            return low


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(500, i) for i in range(501, 560)]
    frame = spark.createDataFrame(edges + [(None, 3), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(frame).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    want = reach([e for e in edges if e[0] != e[1]], nodes)
    assert found == want
    assert components(frame.limit(0)).count() == 0


# --- 6 SimHash --------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    counts = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle, 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def test_covering_masks_meet_every_pair():
    masks = simhash.covering_masks()
    for a in range(64):
        for b in range(64):
            assert any(not m & ((1 << a) | (1 << b)) for m in (m % 2**64 for m in masks))


def test_simhash_groups(docs, texts, none):
    rows = simhash.simhash_groups(docs).collect()
    prints = [plain_fingerprint(t) for _, t in texts]
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in rows) == sorted((i or -1, p) for (i, _), p in zip(texts, prints))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    low = reach(links, range(len(texts)))
    ids = {}
    for k, (i, _) in enumerate(texts):
        ids.setdefault(low[k], []).append(i)
    want = sorted((i or -1, min((j for j in ids[low[k]] if j is not None), default=None) or 0) for k, (i, _) in enumerate(texts))
    assert sorted((r.doc_id or -1, r.component_id or 0) for r in rows) == want
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns and kept.count() == len(ids)
    assert simhash.simhash_groups(none).count() == 0 and simhash.keep_one_per_group(none).count() == 0


@pytest.mark.parametrize("pairwise", [1, 24])
def test_crowded_buckets_lose_no_link(spark, pairwise):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for p in list(prints)[:6]:
        for _ in range(40):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.near_links(frame, pairwise=pairwise)).collect()}
    want = reach([(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2], signed)
    assert {p: found.get(p, p) for p in signed} == want


# --- 9 suffixes -------------------------------------------------------------------------------------------------


def without_repeats(texts):
    ordered = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0))
    seen, want = {}, []
    for i, t in ordered:
        key, data = (2**63 if i is None else i), (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            first = seen.setdefault(data[p : p + 50], key)
            if first < key:
                gone[p : p + 50] = True
        spans = int((np.diff(np.r_[False, gone, False].astype(int)) == 1).sum())
        want.append((i or -1, len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return sorted(want)


def removed(df):
    return sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect())


def test_remove_repeats(docs, texts, none):
    want = without_repeats(texts)
    assert removed(docs) == want
    assert sum(w[2] for w in want) > 1000
    assert suffixes.remove_repeats(none).count() == 0


def test_remove_repeats_of_crowded_anchors(spark):
    rng = random.Random(5)
    phrases = [words(rng, 12)[:22], words(rng, 16)[:60]]
    rows = [(i, words(rng, 8) + phrases[i % 2] + words(rng, 8) + phrases[rng.randrange(2)][:rng.randint(20, 60)]) for i in range(600)]
    rows += [(i, rows[i - 600][1] + " " + rows[rng.randrange(600)][1]) for i in range(600, 640)]
    df = table(spark, rows)
    keyed = df.selectExpr("doc_id id", "cast(0 as int) mark", "cast(text as binary) text")
    assert len(suffixes.crowded_anchors(keyed, 1)) > 0
    assert removed(df) == without_repeats(rows)


def test_remove_repeats_of_long_texts(spark):
    rng = random.Random(6)
    base = rng.randbytes(suffixes.CHUNK_BYTES).hex()
    cut = suffixes.CHUNK_BYTES
    rows = [(1, base), (2, "z" * 70 + base[cut - 300 : cut + 300]), (3, "y" * (cut - 100) + base[500:900]), (4, base[7:] + "w")]
    assert removed(table(spark, rows)) == without_repeats(rows)


def test_pieces_hold_every_window_once():
    texts = [b"", b"a" * 49, bytes(range(256)) * (3 * suffixes.CHUNK_BYTES // 256), b"b" * (suffixes.CHUNK_BYTES + 30)]
    starts = {k: [] for k in range(len(texts))}
    for owners, offsets, pieces in suffixes._pieces(texts):
        assert sum(map(len, pieces)) < 2 * suffixes.CHUNK_BYTES + suffixes.THRESHOLD
        for k, offset, piece in zip(owners.tolist(), offsets.tolist(), pieces, strict=True):
            assert texts[k][offset : offset + len(piece)] == piece
            starts[k].append(range(offset, offset + len(piece) - 49))
    for k, text in enumerate(texts):
        assert [p for run in starts[k] for p in run] == list(range(len(text) - 49))


# --- 10 packing -------------------------------------------------------------------------------------------------


def test_pack(docs, texts, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids_of = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
    rows = packing.pack(docs, tokenizer_path()).collect()
    whole, sequences = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        whole.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts:
        if [j for j, _ in texts].count(i) == 1:
            assert b"".join(p for _, p, _ in sorted(whole[i])) == ids_of(t) and {n for _, _, n in whole[i]} == {len(ids_of(t)) // 4}
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) // 4 for _, t in texts)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_balance_fills_windows():
    rng = random.Random(2)
    sizes = [s for k in range(900) for s in packing.cut(rng.randint(1, 5000), k % packing.LADDER_EVERY == 0)]
    packed = packing.pack_block(sizes)
    assert sorted(i for items in packed for i in items) == list(range(len(sizes)))
    assert sum(sizes) / (2048 * len(packed)) > 0.98
    assert packing.balance([], 0) == []


def test_words_match_the_tokenizer():
    from tokenizers import Tokenizer

    odd = ["a\x1cb c", "it's  l'été 123 don't", "<|endoftext|> x<|startoftext|>y", "ＡＢＣ Σας İ", "\u2003wide\u00a0space\x85next", "e\u0301 \u0301x", "🙂🙂 汉字"]
    tokenizer, mine = Tokenizer.from_file(tokenizer_path()), packing.Words(tokenizer_path(), most=3)
    for text, ids in zip(odd * 2, mine.ids(odd) + mine.ids(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# --- 8 mixing ---------------------------------------------------------------------------------------------------


def test_mix(spark, docs, none):
    mixed = mixing.mix(docs.withColumn("__copy", F.lit("clash")))
    rows = mixed.collect()
    assert set(mixed.columns) == set(docs.columns) | {"__copy", "__copies", "__order"}
    groups = {}
    for r in rows:
        groups.setdefault((r.doc_id, r.text, r.source), []).append(r)
    for group in groups.values():
        assert len(group) % group[0]["__copies"] == 0 and {r["__copy"] for r in group} == set(range(1, group[0]["__copies"] + 1))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).select(mixed.columns).collect()))
    assert mixing.mix(none).count() == 0
    weights = spark.createDataFrame([("s0", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(docs, weights=weights).collect()} <= {"s0"}


def test_mix_reaches_its_targets(spark):
    many = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 30 == 0, "rare").otherwise("common").alias("source"),
    )
    weights = spark.createDataFrame([("rare", 3.0), ("common", 1.0)], "source string, weight double")
    counts = {r.source: r["count"] for r in mixing.mix(many, weights=weights).groupBy("source").count().collect()}
    assert abs(counts["rare"] - 22_500) < 1200 and abs(counts["common"] - 7_500) < 600  # rate 22.5 is drawn in two parts


# --- 7 chat -----------------------------------------------------------------------------------------------------


def test_rebuild_folds_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "open", "user", None), (1, 1, 0, "delta", None, "he"), (1, 2, 0, "delta", None, "llo"),
        (1, 3, 1, "open", "assistant", None), (1, 4, 1, "delta", None, "bad"), (1, 5, 1, "regenerate", None, None),
        (1, 6, 1, "delta", None, "go"), (1, 7, 1, "delta", None, "od"), (1, 8, 0, "edit", None, "hi"), (1, 9, 0, "delta", None, "!"),
        (2, 0, 0, None, None, None), (None, 0, None, "delta", None, "lost"),
    ]
    frame = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    rows = {(r.conv_id, r.message): (r.role, r.text) for r in chat.rebuild(frame.orderBy(F.rand(1))).collect()}
    assert rows == {(1, 0): ("user", "hi!"), (1, 1): ("assistant", "good"), (2, 0): ("", ""), (None, None): ("", "lost")}


def test_render_is_reversible(spark):
    odd = ["", "\\", "\\\\h", "###", "</turn>", "\\### </turn>\n### user ###\n", "####</turn</turn>>", "a\\e\\\\", None, "é\n\n", " ###\n"]
    rows = [(k, k % 5, r, t) for k, (r, t) in enumerate((r, t) for r in ("user", "assistant", None, "we### \\ird\n") for t in odd)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = chat.parse(chat.render(chat.rebuild(chat.to_events(frame.union(frame.limit(1))))))
    found = sorted((r.conv_id, r.role, r.text, r.learned) for r in read.collect())
    want = sorted((k, r or "", t or "", (t or "") if r == "assistant" else "") for k, _, r, t in rows + rows[:1])
    assert found == want
    assert chat.rebuild(chat.to_events(frame.limit(0))).count() == 0


# --- 1 and 2 embeddings -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    rows = [(k, (centres[k % 40] + rng.normal(scale=0.08 if k % 3 else 0.02, size=24)).tolist()) for k in range(400)]
    rows += [(k, rows[0][1]) for k in range(400, 440)]
    rows += [(450, None), (451, [0.0] * 24), (452, [float("nan")] * 24), (453, [None] * 24), (454, [1.0, 2.0]), (455, [2.0, 4.0]), (456, []), (None, rows[3][1]), (3, rows[3][1]), (457, [float("inf")] * 24)]
    return rows


def test_near_duplicates(spark, vectors):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, cid long, n_links long")
    unit = [None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v) / np.linalg.norm(v) for _, v in vectors]
    links = [(a, b) for a in range(len(unit)) for b in range(a) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    degree = np.zeros(len(unit), int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    rows = embeddings.near_duplicates(frame).collect()
    assert len(rows) == len(vectors)
    found = sum(r.n_links for r in rows)
    assert 0.98 * degree.sum() <= found <= degree.sum()
    low = reach(links, range(len(unit)))
    members = {}
    for k, (i, _) in enumerate(vectors):
        members.setdefault(low[k], []).append(i)
    want = sorted((vectors[k][0] or -1, min((i for i in members[low[k]] if i is not None), default=-1)) for k in low)
    assert sorted((r.vec_id or -1, r.component_id if r.component_id is not None else -1) for r in rows) == want
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_chunks_of_a_large_bucket_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(5)
    rows = [(k, (np.ones(16) + rng.normal(scale=0.01, size=16)).tolist()) for k in range(120)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in found} == {119} and {r.component_id for r in found} == {0}


def test_topk(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    monkeypatch.setattr(topk, "QUERIES", 3)
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score long")
    rows = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, a) in enumerate(rows):
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(rows) if m != n and len(b) == len(a))
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    found = [tuple(r) for r in topk.search(frame, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(found) == sorted(want)
    assert topk.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_never_lose_a_best_candidate():
    rng = np.random.default_rng(6)
    queries, block = rng.integers(-50, 50, (30, 12)).astype(float), rng.integers(-50, 50, (300, 12)).astype(float)
    left = topk.open_candidates(queries, block, 6, np.zeros((30, 300), dtype=bool))
    scores = queries @ block.T
    assert left[scores >= np.sort(scores, axis=1)[:, [-6]]].all() and not left.all()


def test_topk_of_rows_that_share_the_id_of_a_query(spark):
    """Ten strong rows of the query's id are candidates like any other; only the query's own row is not."""
    rng = np.random.default_rng(8)
    rows = [(50, [9.0 + k, 9.0]) for k in range(10)] + [(50, [9.0, 9.0])] + [(k, rng.normal(size=2).tolist()) for k in range(1, 40)]
    found = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    coded = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for n in range(11):
        scored = sorted((-sum(x * y for x, y in zip(coded[n][1], b)), i) for m, (i, b) in enumerate(coded) if m != n)
        want += [(50, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, found)) == sorted(want)


def test_near_duplicates_of_very_large_and_small_vectors(spark):
    base = [0.3, -0.2, 0.9, 0.1]
    rows = [(k, [x * scale for x in base]) for k, scale in enumerate((1.0, 1e200, 1e-200, 1e300, 5e-300))] + [(9, [1.0, 1.0, -1.0, 0.0])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {**{k: (4, 0) for k in range(5)}, 9: (0, 9)}


# --- 4 lines ----------------------------------------------------------------------------------------------------


def shingles(text, n=5):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def test_dedup_lines(spark, none):
    rng = random.Random(8)
    base = [words(rng, rng.choice([6, 15, 60])) for _ in range(60)]
    edited = [" ".join(w if k != 5 else "edit" for k, w in enumerate(line.split())) for line in base]
    rows = [(i, "\n".join(rng.choice(base + edited) for _ in range(rng.randint(1, 6))) + "\n- x\n--\n") for i in range(80)]
    rows += [(90, "Read more\n\n* * *"), (91, "read more \n\n* * *\nRead mores\n\u041e \u043d\u0430\u0441"), (92, "\u043e \u043d\u0430\u0441\n7")]
    rows += [(100, None), (101, ""), (None, base[0]), (3, rows[3][1]), (102, "\n".join(["same line for all of them"] * 40)), (103, words(rng, 3000))]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 1, 2.0) for i, t in rows], DOCS)
    found = lines.dedup_lines(frame).collect()
    first = {}
    for i, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate(t.split("\n")):
            key = line.strip().lower()
            if any(c.isalnum() for c in key):
                first.setdefault(key, (i is None, i or 0, n))
    keys = list(first)
    sets = [shingles(k) for k in keys]
    links = [(a, b) for a in range(len(keys)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b] or "x") >= 0.8 and min(len(keys[a]), len(keys[b])) >= lines.LEAST_CHARS]
    low = reach(links, range(len(keys)))
    stays = {}
    for k, key in enumerate(keys):
        stays[low[k]] = min(stays.get(low[k], (True, 1 << 60, 0)), first[key])
    kept = set(stays.values())
    want = []
    for i, t in rows:
        some = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not any(c.isalnum() for c in x) or (i is None, i or 0, n) in kept)
        want.append((i or -1, some))
    assert links and sorted((r.doc_id or -1, r.text or "~") for r in found) == sorted((i, t or "~") for i, t in want)
    assert lines.dedup_lines(none).count() == 0


def test_line_columns_of_any_name(spark):
    """Columns named like those that the operator works with, and like those that it adds."""
    names = ["row", "doc", "lines", "places", "staying", "n", "line", "norm", "place", "lid", "__doc", "__places", "__pairs", "__lines", "a.b"]
    text = "a line of some length that comes twice"
    rows = [(i, text, *[f"{name}{i}" for name in names]) for i in (1, 2)]
    schema = ", ".join(["doc_id long", "text string", *[f"`{name}` string" for name in names]])
    found = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, schema)).collect()}
    assert [found[i]["text"] for i in (1, 2)] == [text, ""]
    assert [(found[i]["__lines"], found[i]["__kept"]) for i in (1, 2)] == [(1, 1), (1, 0)]
    assert all(found[i][name] == f"{name}{i}" for i in (1, 2) for name in names if name != "__lines")


def test_lines_in_large_buckets(spark):
    rng = random.Random(9)
    base = words(rng, 50)
    rows = [(i, base.replace(base.split()[i % 50], f"new{i}", 1)) for i in range(60)] + [(100 + i, words(rng, 40)) for i in range(5)]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found if r.text) == [0, 100, 101, 102, 103, 104]


def test_dissimilar_lines_of_a_large_bucket_leave_no_pairs(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(3, 8))) for _ in range(400)]
    origin = rng.choices(words, k=40)
    norms = [" ".join(rng.choice(words) if rng.random() < 0.12 else w for w in origin) for _ in range(80)]
    texts = spark.createDataFrame(list(enumerate(norms)), "lid long, norm string")
    signed = lines.signatures(texts)
    monkeypatch.setattr(lines, "CHUNK", 30)
    members = signed.selectExpr("sid", "0 AS band", "7L AS bucket", f"{len(norms)}L AS size")
    none = spark.createDataFrame([], "node long, root long")
    found = {(r["a"], r["b"]) for r in lines.crossing_pairs(members, signed, none, texts).collect()}
    sets = [{t[i : i + lines.SHINGLE] for i in range(len(t) - lines.SHINGLE + 1)} for t in norms]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(norms)) for a in range(b)}
    rows = {r["sid"]: r[1:] for r in signed.select("sid", *[f"m{i}" for i in range(lines.BANDS * lines.ROWS)]).collect()}
    likely = {(a, b) for a, b in alike if sum(x == y for x, y in zip(rows[a], rows[b], strict=True)) >= lines.LIKELY}
    assert {pair for pair in likely if alike[pair] >= lines.SIMILARITY} <= found <= likely
    assert len(likely) > 1000 and all(alike[pair] > 0.65 for pair in found) and len(found) < len(likely) / 3


def test_lines_of_some_words_are_signed_both_ways(spark):
    kinds = {10: {True}, 12: {True, False}, 18: {True, False}, 19: {False}, 60: {False}}
    rows = [(n, " ".join(f"word{k}" for k in range(n))) for n in kinds] + [(1, "ab " * 200), (2, "d" * 30 + " word" + " abc de fgh ij k lm" + "é" * 300)]
    rows.append((3, " ".join(f"longerword{k}ofall" for k in range(30))))
    signed = lines.signatures(spark.createDataFrame(rows, "lid long, norm string")).select("sid").collect()
    found: dict[int, set] = {}
    for (sid,) in signed:
        found.setdefault(~sid if sid < 0 else sid, set()).add(sid < 0)
    assert found == kinds | {1: {True}, 2: {True}, 3: {True, False}}


def test_similar_short_lines_go(spark):
    """Lines of 5 to 15 characters, among them pairs around the former bound of 16 and one of few different shingles."""
    texts = ["read more", "read mores", "share this page", "share this pages", "abcdefghijklmnop", "abcdefghijklmno", "ha ha ha ha", "ha ha ha ha ha ha", "page 10", "page 101", "abcd", "abcde"]
    found = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.text for r in found if r.text) == sorted(["read more", "share this page", "abcdefghijklmnop", "ha ha ha ha", "page 10", "page 101", "abcd", "abcde"])


def test_long_lines_of_any_script_are_signed_whole(spark):
    """Near copies in Cyrillic that differ in their only Latin words, and pairs of which one has hardly any a, e or n."""
    rng = random.Random(10)
    rows = []
    for i in range(30):
        body = "".join(rng.choice("бвгдежзиклмнопрст ") for _ in range(400))
        rows += [(i, body[:200] + "".join(rng.choice("aen") for _ in range(14)) + body[200:]) for i in (2 * i, 2 * i + 1)]
    for i in range(30, 60):
        body = "".join(rng.choice("bcdfghijklm ") for _ in range(300))
        rows += [(2 * i, body + " bcd"), (2 * i + 1, body + " aeneaneaeneae")]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found if r.text) == list(range(0, 120, 2))


def test_small_clusters_in_large_buckets(spark, monkeypatch):
    """Lines of one template that are not similar, each with one near copy: every copy goes, in buckets of several chunks."""
    monkeypatch.setattr(lines, "CHUNK", 32, raising=False)
    rng = random.Random(12)

    def part(n):
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))

    template = part(400)
    rows = []
    for i in range(100):
        own = part(40)
        rows += [(2 * i, f"x{template}{own}{part(29)}x"), (2 * i + 1, f"x{template}{own}{part(29)}x")]
    sets = [shingles(t) for _, t in rows]
    linked = {(a, b) for a in range(200) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert linked == {(2 * i + 1, 2 * i) for i in range(100)}
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found if r.text) == list(range(0, 200, 2))


# --- 3 and 5 classifiers ----------------------------------------------------------------------------------------


def test_kernel_tolerates_inserted_characters():
    k = toxicity.kernels(["moron", "mo-ron".replace("-", "x"), "harvest"], ["moron"])[:, 0]
    assert k[0] > k[1] > 3 * max(k[2], 0.01) and k[0] == pytest.approx(1.0, abs=0.2)
    assert "idiot" in toxicity.units("what an i d i o t here") and toxicity.plain("I.d-I.o_T!") == "idiot"
    assert "idiot" in toxicity.units("i d i o t s-") and "abc" not in toxicity.units("a- b- c-")


def test_runs_of_symbols_are_read_in_time():
    import time

    for text in ("a" + "-_" * 50_000 + "!", "a- " * 40_000, "a -" * 40_000 + "!", "a " * 50_000 + "b-", "_ " * 50_000):
        began = time.process_time()
        toxicity.units(text)
        assert time.process_time() - began < 2
    assert "idiot" in {toxicity.plain(w) for w in toxicity.units("an i-d i_o t so")}


def test_kernel_is_the_weighted_count_of_common_subsequences():
    """Against a count of every subsequence; and the folded weights of a machine against its sum over landmarks."""
    from itertools import combinations

    def features(word):
        told = [1, *(3 + ((c ^ (c >> 7) * 37) % (toxicity.CODES - 3)) for c in map(ord, word)), 2]
        out = {}
        for places in combinations(range(len(told)), toxicity.ORDER):
            if places[-1] - places[0] < toxicity.SPAN:
                key = tuple(told[p] for p in places)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (places[-1] - places[0] + 1)
        return out

    words, marks = ["moron", "mxoron", "harvest", "stupidity"], ["moron", "stupid"]
    found = toxicity.kernels(words, marks) * toxicity.lengths(words)[:, None] * toxicity.lengths(marks)[None, :]
    for i, word in enumerate(words):
        for j, mark in enumerate(marks):
            a, b = features(word), features(mark)
            assert found[i, j] == pytest.approx(sum(a[k] * b.get(k, 0) for k in a), rel=1e-6, abs=1e-9)


def test_bags_as_places():
    import pyarrow as pa

    vocabulary, rows = toxicity.bagged(pa.chunked_array([pa.array([["b", "a"], []]), pa.array([["c", "a"]])]))
    assert vocabulary == ["a", "b", "c"] and [r.tolist() for r in rows] == [[0, 1], [], [0, 2]]
    assert toxicity.bagged(pa.chunked_array([], pa.list_(pa.string()))) == ([], [])
    assert toxicity.cut("x" * 100)[0] == "x" * 40 and "".join(toxicity.cut("abc")) == "abc" and toxicity.cut("") == []


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        toxic, good = i % 4 == 0, i % 5 != 0
        text = words(rng, 40).split()
        if toxic:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(["zqmoron", "zqmorons", "vkclown"])
        if not good:
            text = [t.upper() + "!!" for t in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None), (901, ""), (902, words(rng, 30) + " zqmxoron, vk.clown zqmorons!"), (None, words(rng, 20)), (5, rows[5][1]), (903, words(rng, 9000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, 9.0) for i, t in rows], DOCS)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    return docs.cache(), marks.cache()


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, labelled, none, module, label):
    docs, marks = labelled
    model = module.train(docs, marks, label)
    rows = module.scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r[label] for r in marks.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).collect()}
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in held]) >= 0.9
    if label == "toxic":
        assert next(r.score for r in rows if r.doc_id == 902) >= 0.5
    assert module.scores(none, model).count() == 0
    untrained = module.train(none, marks, label)
    assert module.scores(docs, untrained).count() == docs.count()


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(1)
    n = quality.BUCKETS + len(quality.STATS)
    machine = quality.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, quality.RANK)), np.zeros(16), np.ones(16))
    ids, x = np.array([3, 9, 40, 77]), np.array([0.5, -1.0, 2.0, 0.1])
    pairs = sum(machine.factors[ids[a]] @ machine.factors[ids[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert machine.margin(ids, x) == pytest.approx(0.3 + machine.linear[ids] @ x + pairs)


# --- queries and pipeline ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert differences(result, connect(sf_dir), ORACLES[name]) == ""
    else:
        assert result.count() >= 200


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns
        assert kept.count() <= before if name != "mixing" else kept.count() > 0
        if name == "simhash_near_dedup":
            prints = [simhash.fingerprint_of(r.text or "") % 2**64 for r in kept.select("text").collect()]
            assert all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[:k])
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert used.agg(F.max("n")).first()[0] <= 2048
    tokens = {r.doc_id: r.doc_tokens for r in pieces.select("doc_id", "doc_tokens").distinct().collect()}
    assert pieces.agg(F.sum("length")).first()[0] == sum(tokens[r.doc_id] for r in kept.select("doc_id").collect())


def test_words_taken_apart_give_the_same_ids():
    """Letters of many scripts, marks and capitals, with a memory that forgets all the time."""
    rng = random.Random(1)
    letters = "aAbBJzZ\u01f0\u030c\u00c5\u0130\u0131\u03a3\u03c3\u03c2\u00df'.,;:!? \u0301\u00e9\u00c91\uff19\u03a9\u0958"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts += ["I'll", "Don't.", "X.", "A", ".", "J\u030c.", "Ab,", "", "  ", "a\x1cb"]
    words = packing.Words(tokenizer_path(), most=3000)
    want = words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for start in range(0, len(texts), 100):
        for ids, encoded in zip(words.ids(texts[start : start + 100]), want[start : start + 100], strict=True):
            assert list(memoryview(ids).cast("I")) == encoded.ids


def test_plain_words_reach_the_tokenizer_in_rows():
    """Different words of Latin letters with marks around give the ids of the whole text, in far fewer calls than words."""
    rng = random.Random(3)

    class Counted:
        calls = 0

        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            Counted.calls += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    made = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    plain = [made("abcdeABC") + rng.choice(["", ".", "!!", "&&&", "')", "..."]) for _ in range(3000)]
    plain += [rng.choice(["", '"', "(", '(["']) + made("aeéÉßñǰŉµªÅ") + rng.choice(["", ",", "'"]) for _ in range(3000)]
    odd = ["<|endoftext|>", "<|ENDOFTEXT|>", "(endoftext|>", "'tis", "it's", "'s", "x'S.", "--", "a-b", "3rd", "İx", "é", '"́a', "a b", "a\x1cb", "a\x0bb", "×a", ""]
    texts = [" ".join(rng.sample(plain, 300)) for _ in range(40)] + [" ".join(rng.sample(odd, 9)) + "\n" for _ in range(40)] + [" \n\t", ""]
    words = packing.Words(tokenizer_path())
    want = words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for name in ("tokenizer", "plain"):
        if hasattr(words, name):
            setattr(words, name, Counted(getattr(words, name)))
    for ids, encoded in zip(words.ids(texts), want, strict=True):
        assert list(memoryview(ids).cast("I")) == encoded.ids
    assert Counted.calls < 300
    assert words.ids([]) == []


def test_packing_holds_little_in_a_worker():
    """Plain words are not remembered, and texts are taken apart in stretches of bounded size."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=8)) + "." for _ in range(500)) for _ in range(20)]
    words = packing.Words(tokenizer_path())
    assert len(words.ids(texts)) == len(texts)
    assert words.recent.held + words.cores.held < 100_000
    column = pa.array([*texts, None, "x" * 20_000, "", "y"])
    stretches = list(packing.chunks(column, 10_000))
    assert [start for start, _ in stretches] == [sum(len(s) for _, s in stretches[:k]) for k in range(len(stretches))]
    assert [text for _, some in stretches for text in some.to_pylist()] == [text or "" for text in column.to_pylist()]
    assert all(sum(map(len, some.to_pylist()[:-1])) < 10_000 for _, some in stretches)


def test_a_round_of_components_shuffles_its_tables_once(spark, monkeypatch):
    plans = []
    put = common.Stash.put

    def recorded(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return put(self, df)

    monkeypatch.setattr(common.Stash, "put", recorded)
    edges = spark.createDataFrame([(a, a + 1) for a in range(40)], "a long, b long")
    assert {r["root"] for r in common.components(edges).collect()} == {0}
    assert len(plans) > 3
    for plan in plans[2:]:  # the rounds: each table meets the others once, and no table is the union of three
        assert "Union" not in plan and plan.count("Join ") <= 4, plan


def test_lines_that_meet_none_move_their_signature_once(spark, monkeypatch):
    stashed = []
    put = lines.Stash.put

    def recorded(self, df):
        back = put(self, df)
        if "m0" in back.columns and "root" not in back.columns:
            stashed.append(back.count())
        return back

    monkeypatch.setattr(lines.Stash, "put", recorded)
    rng = random.Random(3)
    alone = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(24)) for _ in range(30)]
    rows = [(k, text) for k, text in enumerate([*alone, alone[0] + " end"])]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["__kept"] for r in found} == {k: int(k < 30) for k in range(31)}
    assert stashed == [31, 2]


def test_distinct_lines_are_signed_once_where_they_lie(spark, monkeypatch):
    signed = []
    sign = lines.signatures

    def recorded(rows):
        out = sign(rows)
        signed.append((rows.count(), out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(lines, "signatures", recorded)
    rng = random.Random(4)
    texts = [words(rng, 20) for _ in range(12)]
    rows = [(k, "\n".join(texts)) for k in range(20)]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r["doc_id"]: r["__kept"] for r in found} == {k: 12 * (k == 0) for k in range(20)}
    ((count, plan),) = signed
    assert count == 12 and "Exchange" not in plan, plan
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("dealt_")]


@pytest.mark.parametrize("dealt", [False, True])
def test_written_tables_leave_no_shuffle_files(spark, dealt):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return set(re.findall(r"shuffle_\d+_\d+_\d+", blocks.getAllFiles().mkString(" ")))

    stash, before, setting = common.Stash(spark, "left"), shuffled(), spark.conf.get(common.CLEANUP, None)
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    back = stash.put_dealt(frame, "k") if dealt else stash.put(frame)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(common.CLEANUP, None) == setting
    assert back.columns == ["k", "count"] and back.agg(F.sum("count")).first()[0] == 1000
    stash.drop(back)


def test_shingles_are_those_of_characters(spark):
    texts = ["abcdefg", "abcd", "", "aaaaaaaaaa", "żółć gęślą jaźń", "x😀yz😀😀ab😀", "日本語のテキスト日本語のテキスト"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.size(lines.shingle_hashes(F.col("t"))).alias("n"))
    assert {r["t"]: r["n"] for r in frame.collect()} == {t: len({t[i : i + 5] for i in range(len(t) - 4)}) for t in texts}

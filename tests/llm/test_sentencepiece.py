"""SentencePiece encoding and decoding against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import pieces
from ledgerline.llm.common import Recent, table
from ledgerline.llm.queries import QUERIES, tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def texts(library):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABC0123456789 .,!?\n\t\r▁éü中文字ーのΑяжд🙂́\x00\x1c�"
    rows = ["", " ", " " * 40, " " * 17 + "a", "▁▁▁a", "\n", "hello  world", "<s></s><unk><0x0A>", "x" * 9000, "ab" * 3000, "=-" * 3000, " " * 7000]
    rows += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    parts = ["ab ", " ", "a", "e", "the ", "ing", "ng", "  =", "--", "0", "aA"]
    rows += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    rows += ["".join(library.id_to_piece(rng.randrange(3, 32000)) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    return rows


@pytest.mark.parametrize("longest", [2048, 4])
def test_encode_and_decode_as_the_library(library, texts, longest, monkeypatch):
    """With a small limit every segment of more than four symbols takes the queue."""
    monkeypatch.setattr(pieces, "LONG", longest)
    vocabulary = pieces.Vocabulary(MODEL)
    for ids, want in zip(vocabulary.encode(texts), library.encode(texts), strict=True):
        assert ids.tolist() == want
        assert vocabulary.decode(ids) == library.decode(want)


def test_decode_of_any_ids(library):
    rng = random.Random(5)
    vocabulary = pieces.Vocabulary(MODEL)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 9))]
        assert vocabulary.decode(np.array(ids, dtype=np.int32)) == library.decode(ids)


def test_a_small_memory_of_words_changes_nothing(library, texts):
    vocabulary = pieces.Vocabulary(MODEL)
    vocabulary.words.most = 5000
    for start in range(0, 600, 20):
        some = texts[start : start + 20]
        assert [i.tolist() for i in vocabulary.encode(some)] == library.encode(some)
    assert vocabulary.words.held <= 5000


def test_recent_keeps_what_is_met_again():
    asked = []

    def encode(words):
        asked.extend(words)
        return [w.encode() for w in words]

    recent = Recent(encode, most=2000)
    for i in range(100):
        assert recent.joined([["often", f"once{i}", "often"]]) == [f"oftenonce{i}often".encode()]
        assert len(recent.now) + len(recent.last) < 30
    assert asked.count("often") == 1


def test_rows(spark, library):
    """Nulls, repeated rows and ids, extra columns with the names of the result, an empty table."""
    long = "Ein sehr langer Text, " * 20_000
    rows = [(1, "a b", 7), (1, "a b", 7), (2, None, 8), (None, "c", 9), (3, "", 1), (4, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumn("n_tokens", F.lit(0))
    out = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    want = sorted(((i, library.encode(t or ""), t or "") for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.ids, r.text) for r in out), key=str) == want
    assert pieces.decode(pieces.encode(docs.limit(0), MODEL), MODEL).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [None])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(lists, MODEL).collect()} == {1: "", 2: "", 3: library.decode([0])}


def test_query(spark, sf_dir, library):
    found = {r.doc_id: r for r in QUERIES["op11_sentencepiece"](spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "")
        row = found[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()

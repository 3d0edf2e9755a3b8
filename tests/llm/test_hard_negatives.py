"""Hard-negative mining against a comparison of all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import negatives

FIELDS = "vec_id long, embedding array<double>, label int, block int, key string"


def code(x):
    return math.floor(256.0 * x)


def plain(rows, anchor, k_pos=5, k_neg=10, low=30, high=90):
    sound = [
        (i, [code(x) for x in v], label) for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, v, label) in enumerate(sound):
        if not anchor(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, tag) for b, (j, w, tag) in enumerate(sound) if a != b and len(w) == len(v)]
        positives = sorted([s for s in scored if s[2] == label], key=order)[:k_pos]
        for p, j, _ in positives:
            fits = sorted([s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p], key=order)[:k_neg]
            out += [(i, j, rank, n, p, s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], FIELDS)
    found = negatives.mine(frame, F.col("vec_id") % 4 == 0, **more)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    out = [(i, [c + rng.gauss(0, 0.4) for c in centers[i % 4]], i % 3) for i in range(150)]
    out += [(200 + i, [round(rng.gauss(0, 1), 1) for _ in range(2)], rng.randrange(3)) for i in range(40)]  # other lengths, many ties
    out += [(300 + i, [0.5] * 6, 1) for i in range(60)] + [(400 + i, [0.4] * 6, i % 2) for i in range(30)]  # many copies
    out += [(4, out[4][1], 1), (4, out[4][1], 1), (8, [0.1] * 6, 2), (None, [0.3] * 6, 1), (None, [0.45] * 6, 0)]  # repeated and null ids
    out += [(500, None, 1), (504, [1.0] * 6, None), (508, [None] * 6, 1), (512, [float("nan")] * 6, 1), (516, [float("inf")] * 6, 1), (520, [], 1), (524, [], 2)]
    return out + [(528, [0.0] * 6, 1), (532, [0.0] * 6, 0), (536, [-1.0] * 6, 7)]


@pytest.mark.parametrize("block", [8192, 20])
def test_as_all_pairs(spark, rows, block, monkeypatch):
    """In one block and in many; nulls, ties, copies, repeated ids, other lengths, extra columns with clashing names."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    assert mined(spark, rows) == plain(rows, lambda i: i is not None and i % 4 == 0)


def test_other_windows(spark, rows):
    anchor = lambda i: i is not None and i % 4 == 0
    assert mined(spark, rows, positives=2, negatives=3, low=-50, high=120) == plain(rows, anchor, 2, 3, -50, 120)


def test_products_beyond_doubles_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1e6, 3e5 + 1 / 256, 7e6 + 3 / 256, 2e5]) for _ in range(3)], i % 2) for i in range(40)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 4 == 0)
    assert negatives.whole(np.array([[1e300, -0.5]]))[0].tolist() == [int(1e300) * 256, -128]


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(4, [1.0], 1)]) == []


def test_boxes_prune():
    """Clustered rows: far fewer products than rows times queries, and the same best rows."""
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 300, (40, 8))
    points = np.floor(centers[rng.integers(0, 40, 20_000)] + rng.normal(0, 5, (20_000, 8)))
    tree = negatives.Tree(points, np.arange(20_000), np.zeros(20_000, dtype=np.int64), np.arange(20_000))
    queries = points[:50]
    told = list(tree.ask(queries, [0] * 50, list(range(50)), [[(-(2**62), 2**62)]] * 50, True, 5))
    for q in range(50):
        scores = points @ queries[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(20_000), -scores))[:5]
        assert told[q][0] == [(int(scores[i]), int(i)) for i in want]
    assert tree.scored < 0.3 * 50 * 20_000


def test_leaves_hold_every_row_once():
    points = np.random.default_rng(1).normal(size=(1000, 5))
    leaves = negatives.tiles(points, 32)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000))
    assert max(len(part) for part in leaves) <= 32

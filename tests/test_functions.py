from __future__ import annotations

import json
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import expected_id
from ledgerline.functions import (
    Json,
    casefold,
    decimal_text,
    instant_text,
    is_blank,
    json_ids,
    json_text,
    normalize_identifier,
    scope_text,
    stable_id,
)
from ledgerline.functions.text import normalize_question
from ledgerline.operators.evidence import evidence_id

TEXTS = st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=12), min_size=1, max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=TEXTS)
def test_json_and_ids_match_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", json_text(F.col("s")).alias("j"), stable_id("n", F.col("s"), F.lit("x")).alias("i")).collect()
    for row in rows:
        assert row.j == json.dumps(row.s)
        assert row.i == expected_id("n", row.s, "x")


def test_identifiers_fold_case_and_keep_letters_and_numbers(spark):
    texts = ["GPU-A 1", "gpu a", "Straße", "ΣΑΣ", "ſ", "ﬁ-n", "日本-1", "½ Ⅷ", "--", "", "İ", "P_0001"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for row in df.select("s", normalize_identifier(F.col("s")).alias("n"), casefold(F.col("s")).alias("c")).collect():
        assert row.c == row.s.casefold()
        assert row.n == "".join(ch for ch in row.s.casefold() if ch.isalnum())


def test_questions(spark):
    df = spark.createDataFrame([("  How-many\tGPUs \n now ",)], "s string")
    assert df.select(normalize_question(F.col("s"))).first()[0] == "how many gpus now"


def test_decimal_text(spark):
    values = ["4.000000", "0.000000", "120.500000", "100.000000", "-3.250000", "0.000001"]
    df = spark.createDataFrame([(Decimal(v),) for v in values], "d decimal(18,6)")
    assert [r[0] for r in df.select(decimal_text(F.col("d"))).collect()] == ["4", "0", "120.5", "100", "-3.25", "0.000001"]


def test_instants_and_blanks(spark):
    row = spark.sql("select timestamp'2026-01-02 03:04:05' a, timestamp'2026-01-02 03:04:05.000120' b").select(
        instant_text(F.col("a")), instant_text(F.col("b"))
    )
    assert tuple(row.first()) == ("2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05.000120+00:00")
    blanks = spark.createDataFrame([("\t  ",), ("",), (None,), (" x",)], "s string")
    assert [r[0] for r in blanks.select(is_blank(F.col("s"))).collect()] == [True, True, True, False]


def test_scope_in_identifiers_is_its_printed_form(spark):
    df = spark.createDataFrame([("t", "p'q", "s", "r\\1")], "tenant_id string, project_id string, site_id string, version string")
    want = "StateScope(tenant_id='t', project_id=\"p'q\", site_id='s', version='r\\\\1')"
    assert df.select(scope_text()).first()[0] == want
    assert df.select(stable_id("x", scope_text())).first()[0] == expected_id("x", want)


def test_evidence_ids_of_both_locations(spark):
    df = spark.createDataFrame(
        [("a", "h", "tabular", "BOM", 7, ["A", "C"], None, None), ("a", "h", "record", None, None, None, "lines", "k-1")],
        "artifact_id string, content_hash string, location_kind string, sheet string, row bigint, cells array<string>, collection string, record_key string",
    )
    got = [r[0] for r in df.select(evidence_id(df.columns)).collect()]
    assert got == [
        expected_id("evidence", "a", "h", "BOM", 7, ["A", "C"]),
        expected_id("evidence", "a", "h", "record", "lines", "k-1"),
    ]


def test_nulls_numbers_and_lists_in_ids(spark):
    row = spark.range(1).select(
        stable_id(
            "x",
            F.lit(None).cast("string"),
            Json(F.lit(3).cast("string")),
            Json(json_ids(F.array(F.lit("a"), F.lit('b"')))),
        )
    )
    assert row.first()[0] == expected_id("x", None, 3, ["a", 'b"'])


def test_question_white_space_of_any_kind(spark):
    from ledgerline.functions.text import normalize_question

    row = spark.createDataFrame([("how\x1cmany\x85 gpu -\tnow ",)], "q string").select(normalize_question(F.col("q")))
    assert row.first()[0] == "how many gpu now"


def test_numbers_keep_every_digit(spark):
    """Parts of a number against Python's decimals, and which numbers have an exact place."""
    from decimal import Decimal, InvalidOperation

    from ledgerline.functions import fits, has_exact_place, number_parts

    given = ["1", "-2.50", "0", "0.000", "1e3", "1E-6", "1e-7", "0.1234567", "1234567890123", "123456789012.654321", "1234567890120e-1", "+.5", "5.", "-0.0000010",
             "12e400", "", ".", "e5", "abc", "1,5", " 7 ", "--1", "1e", "NaN", "Infinity", "0e999999", "000123.4500", None]
    rows = spark.createDataFrame([(g,) for g in given], "raw string").select("raw", number_parts(F.col("raw")).alias("p"), fits(number_parts(F.col("raw"))).alias("fits"), has_exact_place(F.col("raw")).alias("same"))
    for row in rows.collect():
        assert row.same == row.fits, row
        try:
            value = Decimal(row.raw.strip())
            value = value if value.is_finite() else None
        except (InvalidOperation, AttributeError):
            value = None
        if value is None:
            assert row.p is None and row.fits is None, row
            continue
        assert int(row.p.digits or 0) * (-1 if row.p.negative else 1) == value.scaleb(row.p.scale) if abs(row.p.scale) < 30 else True
        assert row.fits == (value == 0 or (abs(value) < 10**12 and value == round(value, 6))), row

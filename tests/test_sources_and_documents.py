from __future__ import annotations

import hashlib
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fixtures import SCOPE_VALUES, day, expected_id
from ledgerline.operators import documents, provenance, purchasing
from ledgerline.sources import jsonl, workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def raw_workbook(rows_xml: str, shared: str | None = None, sheet: str = "BOM") -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="{sheet}" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows_xml}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{shared}</sst>')
    return buffer.getvalue()


def cell(value: str, ref: str = "") -> str:
    at = f' r="{ref}"' if ref else ""
    return f'<c{at} t="inlineStr"><is><t>{value}</t></is></c>'


HEAD = "<row>" + "".join(cell(h) for h in workbooks.HEADER) + "</row>"


def read(spark, *contents: bytes):
    files = spark.createDataFrame([(f"b{i}.xlsx", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    return workbooks.read_workbooks(files)


def test_declared_coordinates_win(spark):
    sparse = HEAD + f'<row r="7">{cell("GPU", "A7")}{cell("4", "C7")}{cell("100", "D7")}</row>'
    row = read(spark, raw_workbook(sparse))[0].first()
    assert (row.sku, row.description, row.quantity, row.unit_price) == ("GPU", "", 4, 100)
    assert (row.cells, row.row, row.sheet) == (["A", "C", "D"], 7, "BOM")


def test_unreferenced_cells_shared_strings_and_extra_columns(spark):
    shared = "<si><t>GPU</t></si><si><r><t>Acc</t></r><r><t>el</t></r></si>"
    rows = HEAD + '<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c><v>4</v></c><c><v>1e2</v></c><c><v>9</v></c></row>'
    content = raw_workbook(rows + f'<row>{cell("")}{cell("no identifier")}</row>', shared)
    lines = read(spark, content)[0].collect()
    assert [(r.sku, r.description, r.quantity, r.unit_price, r.row) for r in lines] == [("GPU", "Accel", 4, 100, 2)]
    assert lines[0].cells == ["A", "B", "C", "D", "E"]
    assert lines[0].content_hash == hashlib.sha256(content).hexdigest()


def test_bad_workbooks_are_rejected_whole(spark):
    good = raw_workbook(HEAD + f'<row>{cell("A")}{cell("b")}{cell("1.50")}</row>')
    bad = [
        b"not a zip",
        raw_workbook("<row>" + cell("Item") + "</row>"),
        raw_workbook(HEAD, sheet="Other"),
        raw_workbook(HEAD + f'<row>{cell("A")}{cell("b")}{cell("many")}</row>'),
        raw_workbook(HEAD + f'<row>{cell("A", "1A")}</row>'),
        raw_workbook(HEAD + f'<row>{cell("A")}{cell("b")}{cell("NaN")}</row>'),
    ]
    lines, rejected = read(spark, good, *bad)
    assert [(r.sku, r.quantity, r.unit_price) for r in lines.collect()] == [("A", Decimal("1.5"), None)]
    assert sorted(r.artifact_id for r in rejected.collect()) == [f"b{i}.xlsx" for i in range(1, 7)]


def test_workbook_files_on_disk(spark, tmp_path):
    rows = [workbooks.HEADER, ["A & B", "d<e>", "2", ""], ["C", "", "1", "3"]]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.xlsx").write_bytes(workbooks.build_workbook(rows))
    (tmp_path / "note.txt").write_text("x")
    lines, rejected = workbooks.read_workbooks(workbooks.workbook_files(spark, str(tmp_path)))
    assert [(r.sku, r.description, r.quantity) for r in lines.orderBy("row").collect()] == [("A & B", "d<e>", 2), ("C", "", 1)]
    assert rejected.count() == 0


def test_structuring_event(spark):
    content = workbooks.build_workbook([workbooks.HEADER])
    digest = hashlib.sha256(content).hexdigest()
    files = spark.createDataFrame([("a.xlsx", bytearray(content))], "path string, content binary")
    run = expected_id("run", "local", "bom-pipeline", "dev", "working-tree", "local", "local", None, [f"artifact:{digest}"])
    prov = expected_id("decision-provenance", run, "xlsx-bom-structurer", "deterministic", "1", *[None] * 5, "bom-xlsx-v1")
    edges = [["used_input", f"artifact:{digest}"], ["used_schema", "schema:bom-xlsx-v1"]]
    want = expected_id("transformation-event", "document-structuring", prov, edges, [f"structured-bom:{digest}:BOM"], [])
    assert workbooks.structuring_events(files).first().transformation_event_id == want


def test_columns():
    for number, letters in ((0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")):
        assert workbooks.column_letters(number) == letters and workbooks.column_number(letters) == number


def test_jsonl_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"commitment_id":"c","quantity":12,"promised_date":"2026-09-18","status":"confirmed"}\n')
    row = jsonl.read_source(spark, "commitments", str(tmp_path / "c.jsonl")).first()
    assert row.quantity == 12 and str(row.promised_date) == "2026-09-18" and row.item_id is None
    (tmp_path / "i.jsonl").write_text('{"item_id":"i","aliases":["x","y"],"unit":"reel"}\n')
    assert jsonl.read_source(spark, "items", str(tmp_path / "i.jsonl")).first().aliases == ["x", "y"]


def test_json_export_renders_decimals_as_text(spark):
    df = spark.createDataFrame([(Decimal("4.500000"), None)], "quantity decimal(18,6), price decimal(18,6)")
    assert jsonl.as_json(df).first()[0] == '{"quantity":"4.5","price":null}'


def test_structure_map_normalize(spark):
    docs = spark.createDataFrame([("d", "h", "title\n\n12.5\nx\n")], "artifact_id string, content_hash string, text string")
    elements = documents.structure(docs, "notes", F.when(F.col("ordinal") == 0, "heading").otherwise("line"))
    assert [(r.ordinal, r.text) for r in elements.orderBy("ordinal").collect()] == [(0, "title"), (1, ""), (2, "12.5"), (3, "x"), (4, "")]
    mapping = spark.createDataFrame([("line", "amount", "v1")], "kind string, field_name string, mapping_schema string")
    mapped = documents.map_fields(elements, mapping)
    assert [r.status for r in mapped.orderBy("ordinal").collect()] == ["unresolved", "observed", "observed", "unresolved"]
    types = spark.createDataFrame([("amount", "decimal", "kg", Decimal("0.001"))], "field_name string, value_type string, unit string, factor decimal(9,6)")
    seen = {r.ordinal: r for r in documents.normalize(mapped, types).collect()}
    assert seen[2].num == Decimal("0.0125") and seen[2].status == "observed"
    assert seen[3].status == "unresolved" and "parse" in seen[3].diagnostic
    assert seen[1].status == "unresolved" and "missing" in seen[1].diagnostic
    assert documents.observation_assertions(documents.normalize(mapped, types)).count() == 1


def test_capture_rejects_early_captures(spark):
    refs = spark.createDataFrame(
        [("dms", u, "t", "p", "s", "v", day(d), None) for u, d in (("a", 1), ("b", 9), ("c", 1))],
        "source_system string, source_uri string, tenant_id string, project_id string, site_id string, version string, observed_at timestamp, source_version string",
    )
    contents = spark.createDataFrame(
        [(u, "hash", "text/plain", 3, day(5)) for u in "ab"],
        "source_uri string, content_hash string, media_type string, byte_length bigint, captured_at timestamp",
    )
    kept, rejected = documents.capture(refs, contents, F.lit("prov"))
    row = kept.first()
    assert kept.count() == 1 and row.source_uri == "a"
    assert {r.source_uri: r.rejection for r in rejected.collect()} == {"b": "captured before it was observed", "c": "not captured"}
    ref = expected_id("source-reference", "dms", "a", "StateScope(tenant_id='t', project_id='p', site_id='s', version='v')", "2026-01-01T00:00:00+00:00", None)
    assert row.artifact_id == expected_id("artifact", ref, "hash", "text/plain", 3, "2026-01-05T00:00:00+00:00", "prov")


def test_purchase_order_totals_and_coverage(spark):
    scope = ("t", "p", "s", "r1")
    ddl = "tenant_id string, project_id string, site_id string, version string, "
    po = spark.createDataFrame(
        [(*scope, "PO-1", "boq-1", "line-1", Decimal("2.5"), Decimal("100.25")), (*scope, "PO-1", None, None, Decimal(1), Decimal(1)),
         ("t", "p", "s", "r2", "PO-2", "boq-1", "line-2", Decimal(9), Decimal(1))],
        ddl + "order_number string, boq_id string, boq_line_id string, quantity decimal(18,6), unit_price decimal(18,6)",
    )
    totals = {r.order_number: r.total for r in purchasing.order_totals(po).collect()}
    assert totals["PO-1"] == Decimal("251.625")
    boq = spark.createDataFrame(
        [(*scope, "boq-1", "line-1", "gpu", Decimal("2.5")), (*scope, "boq-1", "line-2", "cpu", Decimal(4))],
        ddl + "boq_id string, line_id string, item_key string, quantity decimal(18,6)",
    )
    rows = {r.line_id: (r.coverage, r.uncovered_quantity) for r in purchasing.boq_coverage(boq, po).collect()}
    assert rows == {"line-1": ("covered", 0), "line-2": ("unordered", 4)}


@pytest.mark.parametrize("added", [["a", "b"], ["b", "b", "a"]])
def test_snapshots_are_kept_once_in_order(spark, added):
    row = spark.range(1).select(provenance.with_snapshots(F.array(F.lit("b")), F.array(*[F.lit(a) for a in added])))
    assert row.first()[0] == list(dict.fromkeys(["b", *added]))


def test_undeclared_fields_stay_unresolved(spark):
    fields = spark.createDataFrame(
        [("quantity", "2", "", ""), ("colour", "red", "", ""), ("shade", None, "", "")],
        "field_name string, raw_value string, status string, diagnostic string",
    )
    types = spark.sql("SELECT 'quantity' AS field_name, 'decimal' AS value_type, 'each' AS unit, CAST(1 AS DECIMAL(9,6)) AS factor")
    rows = {r.field_name: (r.status, r.diagnostic) for r in documents.normalize(fields, types).collect()}
    assert rows == {
        "quantity": ("observed", None),
        "colour": ("unresolved", "field is not declared"),
        "shade": ("unresolved", "source field is missing"),
    }


def test_numbers_without_an_exact_place_are_told(spark):
    """They reject their workbook, and stay unresolved as observations; exponents are numbers like others."""
    from ledgerline.operators import documents
    from ledgerline.sources import workbooks

    def book(quantity, price):
        return workbooks.build_workbook([workbooks.HEADER, ["A", "item", quantity, price]])

    books = [("ok", "2.5E1", "1e-6"), ("many", "1234567890123", "1"), ("fine", "1", "0.1234567"), ("zero", "0.00000000", "")]
    files = spark.createDataFrame([(p, bytearray(book(q, u))) for p, q, u in books], "path string, content binary")
    lines, rejected = workbooks.read_workbooks(files)
    assert {r.artifact_id: (str(r.quantity), r.unit_price and str(r.unit_price)) for r in lines.collect()} == {
        "ok": ("25.000000", "0.000001"), "zero": ("0.000000", None)
    }
    assert {r.artifact_id: r.error.split(":")[0] for r in rejected.collect()} == {"many": "ValueError", "fine": "ValueError"}
    fields = spark.createDataFrame([("n", "1e3"), ("n", "0.1234567"), ("n", "1234567890123"), ("n", "x"), ("n", None)], "field_name string, raw_value string")
    fields = fields.selectExpr("*", "'observed' as status", "cast(null as string) as diagnostic")
    types = spark.createDataFrame([("n", "decimal", "each", None)], "field_name string, value_type string, unit string, factor int")
    told = {r.raw_value: (r.status, r.diagnostic) for r in documents.normalize(fields, types).collect()}
    inexact = ("unresolved", "number has no exact place in 18 digits with 6 decimals")
    assert told == {
        "1e3": ("observed", None), "0.1234567": inexact, "1234567890123": inexact,
        "x": ("unresolved", "value does not parse as declared"), None: ("unresolved", "source field is missing"),
    }


def test_evidence_rules_over_listed_cells(spark):
    """The rules hold for evidence as spreadsheets give it."""
    from ledgerline.quality import checks, rules
    from ledgerline.sources import workbooks

    content = workbooks.build_workbook([workbooks.HEADER, ["A", "item", "1", "2"], ["B", "item", "1"]])
    lines, _ = workbooks.read_workbooks(spark.createDataFrame([("w", bytearray(content))], "path string, content binary"))
    rows = lines.select("line_no", "artifact_id", "content_hash", "location_kind", "sheet", "row", "cells").withColumns(
        {"collection": F.lit(None).cast("string"), "record_key": F.lit(None).cast("string")}
    )
    assert checks.violations(rows, ["line_no"], rules.EVIDENCE_LISTED).count() == 0
    broken = rows.withColumn("cells", F.when(F.col("line_no") == 2, F.array(F.lit("A"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit(" "))))
    found = {(r.line_no, r.rule) for r in checks.violations(broken, ["line_no"], rules.EVIDENCE_LISTED).collect()}
    assert found == {(2, "cells_repeated"), (3, "cells_missing")}


def test_order_references_of_every_kind(spark):
    from ledgerline.operators import purchasing

    bill = spark.createDataFrame(
        [("t", "p", "s", "v", "b1", "l1", 5), ("t", "p", "s", "v", "b1", "l2", 3), ("t", "q", "s", "v", "b2", "l1", 1)],
        "tenant_id string, project_id string, site_id string, version string, boq_id string, line_id string, quantity int",
    )
    orders = spark.createDataFrame(
        [("t", "p", "s", "v", b, ln, q) for b, ln, q in [("b1", "l1", 2), ("b1", "l1", 1), ("b2", "l1", 4), ("b9", "l1", 6), ("b1", None, 7), (None, None, 8), (None, "l1", 9)]],
        "tenant_id string, project_id string, site_id string, version string, boq_id string, boq_line_id string, quantity int",
    )
    found = {(r.project_id, r.boq_id, r.line_id): (r.linked, r.required_quantity, r.ordered_quantity, r.po_lines) for r in purchasing.order_references(bill, orders).collect()}
    assert found == {
        ("p", "b1", "l1"): ("linked", 5, 3, 2), ("p", "b1", "l2"): ("unordered", 3, None, 0), ("q", "b2", "l1"): ("unordered", 1, None, 0),
        ("p", "b2", "l1"): ("scope_mismatch", None, 4, 1), ("p", "b9", "l1"): ("dangling", None, 6, 1), ("p", "b1", None): ("dangling", None, 7, 1),
        ("p", None, None): ("unreferenced", None, 17, 2),
    }


def test_observations_assert_by_the_rule_of_lines(spark):
    observed = spark.createDataFrame(
        [
            (*SCOPE_VALUES.values(), "row-1", "has_quantity", "2.500", "observed", "decimal"),
            (*SCOPE_VALUES.values(), "row-1", "vendor", "Acme", "observed", "text"),
            (*SCOPE_VALUES.values(), "row-2", "vendor", "Acme", "observed", "text"),
            (*SCOPE_VALUES.values(), "row-3", "vendor", " ", "observed", "text"),
            (*SCOPE_VALUES.values(), "row-4", "vendor", None, "unresolved", "text"),
        ],
        "tenant_id string, project_id string, site_id string, version string, record string, field_name string, raw string, status string, value_type string",
    ).selectExpr(
        "*", "case when value_type = 'decimal' then cast(raw as decimal(38,12)) end num", "cast(null as date) date", "cast(null as timestamp) ts",
        "case when value_type = 'text' then raw end text_value", "timestamp'2026-01-01' observed_at",
    )
    made = documents.assert_observations(observed, F.col("record"), F.concat(F.lit("ev-"), "record"))
    ids = {(r.record, r.predicate): r.assertion_id for r in made.collect()}
    assert ids["row-1", "has_quantity"] == expected_id("assertion", "row-1", "has_quantity", "2.5", "ev-row-1", "document", None)
    assert len(ids) == 4
    naming = documents.naming_assertions(made, {"vendor": "organization"})
    mentions = documents.identified_mentions(naming, ["record"])
    one = mentions.first()
    listed = [ids["row-1", "vendor"], ids["row-2", "vendor"]]
    scope = "StateScope(tenant_id='tenant', project_id='project', site_id='site', version='bom-v1')"
    assert (mentions.count(), one.text, one.assertion_count) == (1, "Acme", 2)
    assert one.mention_id == expected_id("entity-mention", "Acme", "organization", listed, scope, "2026-01-01T00:00:00+00:00")
    assert sorted(r.assertion_id for r in documents.mention_links(naming, mentions).collect()) == sorted(listed)
    assert documents.naming_assertions(made, {}).count() == 0

"""Spreadsheet bills of materials: one workbook per input row, many workbooks per job."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from decimal import Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import DECIMALS, WHOLE_DIGITS
from ledgerline.operators import provenance
from ledgerline.schemas import QUANTITY, WORKBOOK_LINES
from ledgerline.session import materialize, ship_package

# Header cells, and the two namespaces of the format.
HEADER = ["SKU", "Description", "Quantity", "Unit Price"]
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

BATCH = 5000


def column_number(letters: str) -> int:
    """Zero-based column of a spreadsheet column name."""
    number = 0
    for letter in letters:
        number = number * 26 + int(letter, 36) - 9
    return number - 1


def column_letters(number: int) -> str:
    letters, rest = "", number + 1
    while rest > 0:
        rest, digit = divmod(rest - 1, 26)
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[digit] + letters
    return letters


class _Workbook:
    """Streaming reader of one sheet."""

    def __init__(self, content: bytes, sheet: str) -> None:
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        self.part = self._part_of(sheet)
        self.strings = self._shared_strings()

    def _xml(self, part: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.archive.read(part))

    def _part_of(self, sheet: str) -> str:
        ids = [
            node.get(RELATION)
            for node in self._xml("xl/workbook.xml").iter(f"{MAIN}sheet")
            if node.get("name") == sheet
        ]
        if not ids:
            raise ValueError(f"no sheet named {sheet}")
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        target = targets.get(ids[0])
        if not target:
            raise ValueError(f"sheet {sheet} leads nowhere")
        return "xl/" + target.lstrip("/").removeprefix("xl/")

    def _shared_strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.archive.namelist():
            return []
        return ["".join(item.itertext()) for item in self._xml("xl/sharedStrings.xml").iter(f"{MAIN}si")]

    def _value(self, cell: ElementTree.Element) -> str:
        kind = cell.get("t")
        node = cell.find(f"{MAIN}is" if kind == "inlineStr" else f"{MAIN}v")
        text = "" if node is None else "".join(node.itertext())
        return self.strings[int(text)] if kind == "s" else text

    def rows(self) -> Iterator[tuple[int, dict[int, str], list[str]]]:
        """Row number, values by column, and populated columns in file order.

        Declared coordinates win over position.
        """
        with self.archive.open(self.part) as stream:
            position = 0
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{MAIN}row":
                    continue
                position += 1
                values: dict[int, str] = {}
                present: list[str] = []
                at = 0
                for cell in row.findall(f"{MAIN}c"):
                    reference = cell.get("r")
                    if reference:
                        match = re.fullmatch(r"([A-Z]+)[1-9][0-9]*", reference.upper())
                        if match is None:
                            raise ValueError(f"bad cell reference {reference}")
                        at = column_number(match[1])
                    values[at] = self._value(cell)
                    present.append(column_letters(at))
                    at += 1
                yield int(row.get("r", position)), values, present
                row.clear()


def _number(text: str) -> str:
    """Decimal text without exponent; a number without an exact place in a quantity or price, like anything else, rejects the workbook."""
    value = Decimal(text)
    if not value.is_finite():
        raise ValueError(f"not a finite number: {text}")
    _, digits, exponent = value.as_tuple()
    kept = "".join(map(str, digits)).rstrip("0").lstrip("0")
    scale = -exponent - (len(digits) - len("".join(map(str, digits)).rstrip("0")))
    if kept and (scale > DECIMALS or len(kept) - scale > WHOLE_DIGITS):
        raise ValueError(f"number without an exact place in {WHOLE_DIGITS} digits and {DECIMALS} decimals: {text}")
    return f"{value:f}" if kept else "0"


def workbook_lines(path: str, content: bytes, sheet: str) -> Iterator[dict]:
    """Line rows of a workbook; rows without an identifier are skipped."""
    digest = hashlib.sha256(content).hexdigest()
    rows = _Workbook(content, sheet).rows()
    head = next(rows, None)
    if head is None or [head[1].get(i, "") for i in range(4)] != HEADER:
        raise ValueError("the first row must hold the bill's header")
    for number, values, present in rows:
        if not values.get(0):
            continue
        if number < 1 or len(set(present)) != len(present):
            raise ValueError(f"row {number} repeats a cell or is not numbered from one")
        price = values.get(3, "")
        yield {
            "artifact_id": path,
            "content_hash": digest,
            "line_no": number,
            "sku": values[0],
            "description": values.get(1, ""),
            "quantity_text": _number(values.get(2, "")),
            "unit_price_text": _number(price) if price else None,
            "sheet": sheet,
            "row": number,
            "cells": present,
            "error": None,
        }


# What reading a single file can raise: broken, encrypted, truncated or unsupported archives, and malformed sheets.
READ_ERRORS = (
    ArithmeticError, EOFError, ElementTree.ParseError, LookupError, NotImplementedError, RuntimeError, ValueError,
    zipfile.BadZipFile, zlib.error,
)


def _parse(batches: Iterator[pd.DataFrame], sheet: str) -> Iterator[pd.DataFrame]:
    columns = WORKBOOK_LINES.fieldNames()
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                rows = list(workbook_lines(path, bytes(content), sheet))
            except READ_ERRORS as problem:
                rows = [dict.fromkeys(columns) | {"artifact_id": path, "error": f"{type(problem).__name__}: {problem}"}]
            for start in range(0, len(rows), BATCH):
                yield pd.DataFrame(rows[start : start + BATCH], columns=columns)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks below a folder, each as one row of bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True)
    return files.load(path).select("path", "content", "length", "modificationTime")


def read_workbooks(files: DataFrame, sheet: str = "BOM") -> tuple[DataFrame, DataFrame]:
    """(lines, rejected workbooks) of files given as (path, content).

    A workbook is read whole or rejected whole; one bad file never fails the job. Files are parsed once, and both results are read from
    what that wrote to the shared folder.
    """
    ship_package(files.sparkSession)
    parsed = files.select("path", "content").mapInPandas(lambda batches: _parse(batches, sheet), WORKBOOK_LINES)
    parsed = materialize(parsed, "workbooks")
    typed = parsed.select(
        *[c for c in parsed.columns if not c.endswith("_text")],
        F.col("quantity_text").cast(QUANTITY).alias("quantity"),
        F.col("unit_price_text").cast(QUANTITY).alias("unit_price"),
        F.lit("observed").alias("status"),
        F.lit("tabular").alias("location_kind"),
    )
    rejected = typed.where(F.col("error").isNotNull()).select("artifact_id", "error")
    return typed.where(F.col("error").isNull()).drop("error"), rejected


def structuring_events(files: DataFrame, sheet: str = "BOM", schema_version: str = provenance.WORKBOOK_SCHEMA) -> DataFrame:
    """One transformation event per file: what was read, under which schema, and what came out."""
    hashed = files.select(F.col("path").alias("artifact_id"), F.sha2("content", 256).alias("content_hash"))
    return events_of(hashed, sheet, schema_version)


def events_of(artifacts: DataFrame, sheet: str = "BOM", schema_version: str = provenance.WORKBOOK_SCHEMA) -> DataFrame:
    """The structuring event of each artifact, given as (artifact_id, content_hash)."""
    snapshot = F.concat(F.lit("artifact:"), F.col("content_hash"))
    context = provenance.local_run(provenance.with_snapshots(F.array().cast("array<string>"), F.array(snapshot)))
    decided = provenance.component_provenance(
        provenance.run_id(context), provenance.STRUCTURER, schema_version=schema_version
    )
    output = F.concat(F.lit("structured-bom:"), F.col("content_hash"), F.lit(f":{sheet}"))
    schema = F.lit(f"schema:{schema_version}")
    return artifacts.select(
        "artifact_id",
        "content_hash",
        snapshot.alias("snapshot_id"),
        schema.alias("schema_id"),
        output.alias("output_id"),
        provenance.transformation_event_id(
            "document-structuring", decided, [("used_input", snapshot), ("used_schema", schema)], [output]
        ).alias("transformation_event_id"),
    )


def with_events(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Lines with the `transformation_event_id` of their artifact; null where no event made it."""
    ids = events.select("artifact_id", "content_hash", "transformation_event_id")
    return lines.join(ids, ["artifact_id", "content_hash"], "left")


def build_workbook(rows: list[list[str]], sheet: str = "BOM") -> bytes:
    """A minimal workbook with inline strings and declared coordinates; for tests and samples."""
    from xml.sax.saxutils import escape

    lines = []
    for number, values in enumerate(rows, start=1):
        cells = "".join(
            f'<c r="{column_letters(i)}{number}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'
            for i, text in enumerate(values)
            if text != ""
        )
        lines.append(f'<row r="{number}">{cells}</row>')
    main, rel = MAIN.strip("{}"), RELATION[1:].removesuffix("}id")
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(zipfile.ZipInfo(name), text)
    return buffer.getvalue()

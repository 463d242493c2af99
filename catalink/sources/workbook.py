"""Cells of spreadsheet files (.xlsx), read from their bytes in tasks: one file is one row of files, so a folder is read in parallel.

`files` is any DataFrame of path and content, such as spark.read.format("binaryFile").load(folder). A cell is
(file, sheet_no, sheet, row, col, value, kind, formula): value as text, kind text, number, date (ISO, with its time), bool or
error; formula where one stands behind the value. A file that can't be read gives one row of kind unreadable.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, sheet_no int, sheet string, row long, col int, value string, kind string, formula string"
#: Cells of a batch.
BATCH = 20_000
#: Names of the format's parts, and built-in number formats that are dates or times.
_MAIN, _REL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_LITERAL = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.')


def _texts(book: zipfile.ZipFile) -> list[str]:
    """Shared strings, each joined from its runs without phonetic hints."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as file:
        for _, item in ElementTree.iterparse(file):
            if item.tag == f"{_MAIN}si":
                out.append(_joined(item))
                item.clear()
    return out


def _joined(item: ElementTree.Element) -> str:
    runs = [x for x in item if x.tag in (f"{_MAIN}t", f"{_MAIN}r")]
    return "".join(t.text or "" for x in runs for t in ([x] if x.tag == f"{_MAIN}t" else x.iter(f"{_MAIN}t")))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Places of cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(x.get("numFmtId", 0)): x.get("formatCode", "") for x in styles.iter(f"{_MAIN}numFmt")}
    dated = {i for i, code in own.items() if re.search("[dmyhs]", _LITERAL.sub("", code.lower())) and "general" not in code.lower()}
    formats = styles.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in _DATES | dated}


def _sheets(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """(name, part) of each sheet in order, and whether dates count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    targets = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    about = root.find(f"{_MAIN}workbookPr")
    place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}")
    return [(x.get("name", ""), place(targets[x.get(f"{_REL}id")])) for x in root.iter(f"{_MAIN}sheet")], about is not None and about.get("date1904") in ("1", "true")


def _moment(days: float, since_1904: bool) -> str:
    """A day number as text; the day 60 of 1900 never was."""
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30) if days >= 60 else datetime(1899, 12, 31)
    return (start + timedelta(milliseconds=round(days * 86_400_000))).isoformat(sep=" ")


def _column(reference: str) -> int:
    n = 0
    for letter in reference:
        if not letter.isalpha():
            break
        n = n * 26 + ord(letter.upper()) - 64
    return n


def cells(content: bytes, first_only: bool = True) -> Iterator[tuple]:
    """(sheet_no, sheet, row, col, value, kind, formula) of a file's cells that hold something."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dated = _texts(book), _date_styles(book)
        sheets, since_1904 = _sheets(book)
        for number, (name, part) in enumerate(sheets[:1] if first_only else sheets):
            row = 0
            with book.open(part) as file:
                for _, item in ElementTree.iterparse(file):
                    if item.tag != f"{_MAIN}row":
                        continue
                    row = int(item.get("r", row + 1))
                    col = 0
                    for c in item.iter(f"{_MAIN}c"):
                        col = _column(c.get("r", "")) or col + 1
                        told = _told(c, shared, dated, since_1904)
                        if told is not None:
                            yield number, name, row, col, *told
                    item.clear()


def _told(c: ElementTree.Element, shared: list[str], dated: set[int], since_1904: bool) -> tuple[str, str, str | None] | None:
    kind, value, formula = c.get("t", "n"), c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f")
    behind = None if formula is None else f"={formula.text or ''}"
    if kind == "inlineStr":
        inside = c.find(f"{_MAIN}is")
        return None if inside is None else (_joined(inside), "text", behind)
    if value is None or value.text is None:
        return None if behind is None else ("", "text", behind)
    text = value.text
    if kind == "s":
        return shared[int(text)], "text", behind
    if kind in ("str", "d"):
        return text, "date" if kind == "d" else "text", behind
    if kind in ("b", "e"):
        return (text if kind == "e" else "TRUE" if text == "1" else "FALSE"), "error" if kind == "e" else "bool", behind
    if int(c.get("s", 0)) in dated:
        return _moment(float(text), since_1904), "date", behind
    return text, "number", behind


def _read(batches: Iterator[pa.RecordBatch], first_only: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("row", pa.int64()), ("col", pa.int32()), ("value", pa.string()), ("kind", pa.string()), ("formula", pa.string())])
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], f.type) for k, f in enumerate(schema)], schema=schema)

    for files in batches:
        for path, content in zip(files.column("path").to_pylist(), files.column("content"), strict=True):
            name, made = (path or "").rsplit("/", 1)[-1], []
            try:
                for cell in cells(content.as_py() or b"", first_only):
                    made.append((name, *cell))
                    if len(made) >= BATCH:
                        held, made = made, []
                        yield batch()
            except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError) as why:
                made.append((name, None, None, None, None, type(why).__name__, "unreadable", None))
            if made:
                held = made
                yield batch()


def workbook_cells(files: DataFrame, first_only: bool = True) -> DataFrame:
    """Cells of all files (path, content); of their first sheets alone unless first_only is off."""
    return files.select("path", "content").mapInArrow(lambda b: _read(b, first_only), SCHEMA)


def workbook_files(spark: SparkSession, folder: str) -> DataFrame:
    """The workbooks of a folder, as `workbook_cells` takes them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(folder)


#: Headers of a catalog workbook.
CATALOG_HEADERS = {"external_id": "Salsify ID", "combined": "Catalog Number - Short Description", "description": "Short Description - en-US", "parent_id": "salsify:parent_id"}


def catalog_rows(found: DataFrame) -> DataFrame:
    """Catalog rows from the cells of workbooks whose first row has the headers CATALOG_HEADERS: file, row, record_type (product or family), external_id, productcode, name, description, parent_id, combined.

    Rows of neither kind, and products without a catalog number, are left out; so are files without all headers.
    """
    from ..operators.ingest import catalog_number, record_class

    known = F.create_map(*(F.lit(x) for k, h in CATALOG_HEADERS.items() for x in (h, k)))
    heads = found.where("row = 1").select("file", "col", known[F.trim("value")].alias("field")).where("field IS NOT NULL")
    whole = heads.groupBy("file").agg(F.count_distinct("field").alias("n")).where(F.col("n") == len(CATALOG_HEADERS)).select("file")
    body = found.where("row > 1").join(heads.join(whole, "file"), ["file", "col"])
    rows = body.groupBy("file", "row").pivot("field", list(CATALOG_HEADERS)).agg(F.max("value"))
    c = F.col
    rows = rows.withColumn("record_type", record_class(c("external_id"), c("combined"), c("description"), c("parent_id")))
    number = F.when(c("record_type") == "product", catalog_number(c("combined")))
    plain = lambda name: F.trim(F.regexp_replace(name, r"\s+", " "))
    rows = rows.where((c("record_type") == "family") | ((c("record_type") == "product") & number.isNotNull())).where("trim(external_id) <> ''")
    return rows.select("file", "row", "record_type", F.trim("external_id").alias("external_id"), number.alias("productcode"), number.alias("name"), plain("description").alias("description"), plain("parent_id").alias("parent_id"), plain("combined").alias("combined"))

"""Workbooks in, results and files out; odd workbooks; observed counts; payloads."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from catalink.operators import export, ingest
from catalink.plans import metrics, process
from catalink.queries_sources import book
from catalink.sources import catalogs, files, workbook

CATALOG = [("1", "TR-90", "TRAY BEND 90 DEGREE", "R12"), ("2", "ID-1", "INNERDUCT ORANGE RIBBED", "1 IN"), ("3", "LT12", "LIQUIDTIGHT FITTING 12", "STRAIGHT")]


@pytest.fixture(scope="module")
def spark():
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def _sheet():
    rows = [(1, 1, "s", "Zone"), (1, 2, "s", "Product Description"), (1, 3, "s", "Qty"), (1, 4, "s", "Part #")]
    lines = [("A", "innerduct orange ribbed", "4", None), ("B", "tray bend 90 degree", None, "tr-90"), ("C", "quote 7 of purple banana", None, None), ("", "Sub total", "11", None)]
    for n, (zone, text, count, part) in enumerate(lines, start=3):
        rows += [(n, 1, "s", zone)] * bool(zone) + [(n, 2, "i", text)] + [(n, 3, "n", count)] * (count is not None) + [(n, 4, "s", part)] * (part is not None)
    return rows


def test_a_quote_from_a_workbook(spark, tmp_path):
    (tmp_path / "q.xlsx").write_bytes(book(_sheet(), 2))
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    read = workbook.workbook_files(spark, str(tmp_path))
    cells = workbook.workbook_cells(read)
    assert [(r.file, r.kind) for r in cells.where("kind = 'unreadable'").collect()] == [("broken.xlsx", "unreadable")]
    assert cells.select("sheet").distinct().where("sheet IS NOT NULL").count() == 1 and workbook.workbook_cells(read, False).where("sheet = 'S2'").count() == len(_sheet())
    catalog = spark.createDataFrame(CATALOG, "id string, name string, description string, description2 string").withColumn("productcode", F.col("id"))
    quote = process.quote_from_cells(cells.where("kind <> 'unreadable'"), catalog, customer="ACME")
    got = {r.source_row: (r.status, r.matched_part, r.quantity, r.source_file, r.source_sheet, r.customer_name) for r in quote.results.collect()}
    assert got == {3: ("EXACT_MATCH", "ID-1", 4.0, "q.xlsx", "S1", "ACME"), 4: ("EXACT_MATCH", "TR-90", None, "q.xlsx", "S1", "ACME"), 5: ("NO_MATCH", None, 7.0, "q.xlsx", "S1", "ACME")}
    assert sorted(map(tuple, quote.order_file().collect())) == [("ID-1", "4"), ("TR-90", "")]
    full = quote.full_file(10)
    assert full.columns == ["Zone", "Product Description", "Qty", "Part #", "other_cells", "line_id", *export.ADDED]
    assert [(r.Zone, r.Qty, r.Status) for r in full.orderBy("Zone").collect()] == [("A", "4", "EXACT_MATCH"), ("B", "", "EXACT_MATCH"), ("C", "", "NO_MATCH")]
    assert tuple(quote.summary().first()) == (3, 2, 0, 1) and quote.warnings.count() == 0 and quote.documents().count() == 3


def test_a_quote_from_pages(spark):
    pages = spark.createDataFrame([("p.pdf", 1, 1, "LIST"), ("p.pdf", 1, 2, "innerduct orange ribbed 1,200"), ("p.pdf", 2, 1, "LIST"), ("p.pdf", 2, 2, "2")], "file string, page int, line_no int, text string")
    catalog = spark.createDataFrame(CATALOG, "id string, name string, description string, description2 string").withColumn("productcode", F.col("id"))
    (row,) = process.quote_from_pages(pages, catalog).results.collect()
    assert (row.status, row.matched_part, row.quantity, row.source_sheet, row.source_row) == ("EXACT_MATCH", "ID-1", 1200.0, "Page 1", 2)


def test_dates_and_odd_cells():
    told = {(r, c): (v, k) for _, _, r, c, v, k, _ in workbook.cells(book([(1, 1, "d", "45323"), (1, 2, "d", "45323.4375"), (1, 27, "n", "1.5"), (2, 1, "d", "1"), (2, 2, "f", "9")]))}
    assert told[1, 1] == ("2024-02-01 00:00:00", "date") and told[1, 2] == ("2024-02-01 10:30:00", "date") and told[2, 1] == ("1900-01-01 00:00:00", "date") and told[2, 2] == ("9", "number")


def test_digests_and_guards(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"abc")
    (tmp_path / "b.XLS").write_bytes(b"abc")
    read = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: (r.sha256, r.length) for r in files.digests(read).collect()}["a.xlsx"] == (hashlib.sha256(b"abc").hexdigest(), 3)
    assert {r.path.rsplit("/", 1)[1]: r.refused for r in files.accepted(read).select("path", "refused").collect()} == {"a.xlsx": None, "b.XLS": files.OLD_FORMAT}
    told = files.accepted(spark.createDataFrame([("c.pdf", b""), ("d.pdf", b"x" * 11), ("e.txt", b"x"), ("f", b"x")], "path string, content binary"), 10)
    assert [r.refused for r in told.orderBy("path").collect()] == [files.EMPTY, files.TOO_LARGE, files.OTHER_FORMAT, files.OTHER_FORMAT]


def test_counts_come_from_the_same_pass(spark):
    lines = spark.range(100).selectExpr("CASE WHEN id % 4 = 0 THEN '' ELSE 'x' END AS requested_description", "CASE WHEN id % 5 = 0 THEN 1D END AS quantity", "CASE WHEN id % 10 = 0 THEN 'bad' END AS error")
    rows, seen = metrics.observed_lines(lines)
    assert rows.count() == 100
    want = lines.selectExpr("count(*)", "count_if(quantity IS NULL)", "count_if(requested_description = '')", "count_if(error IS NOT NULL)").first()
    assert tuple(seen.get.values()) == tuple(want)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Range (") == 1


def test_headerless_files_and_empty_tables(spark):
    schema = "file string, row long, col int, value string, kind string"
    cells = spark.createDataFrame([("f", r, c, v, k) for r in (1, 2, 3) for c, v, k in ((2, f"bolt {r}", "text"), (4, f"{r}.0", "number"))], schema)
    got = [(r.source_row, r.requested_description, r.quantity) for r in ingest.quote_lines(cells).orderBy("source_row").collect()]
    assert got == [(1, "bolt 1", 1.0), (2, "bolt 2", 2.0), (3, "bolt 3", 3.0)] and "No header row" in ingest.cell_warnings(cells).first().warning
    assert ingest.quote_lines(spark.createDataFrame([], schema)).count() == 0 and workbook.workbook_cells(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_catalog_sources(spark, tmp_path):
    spark.createDataFrame([(1, "K1", "rod")], "id long, code string, description string").write.parquet(f"{tmp_path}/c")
    (row,) = catalogs.read_catalog(spark, " Parquet ", f"{tmp_path}/c", {"name": "code", "productcode": "code"}).collect()
    assert (row.id, row.name, row.productcode, row.description2) == ("1", "K1", "K1", None)
    heads = [(1, i + 1, "s", h) for i, h in enumerate(workbook.CATALOG_HEADERS.values())]
    (tmp_path / "book.xlsx").write_bytes(book([*heads, (2, 1, "s", "NA1-K2"), (2, 2, "s", "K2 - bolt"), (2, 3, "s", "BOLT"), (2, 4, "s", "up"), (3, 1, "s", "F"), (3, 2, "s", "-")]))
    rows = catalogs.read_catalog(spark, "excel", str(tmp_path))
    assert [(r.external_id, r.product_code, r.description) for r in ingest.products(rows).collect()] == [("NA1-K2", "K2", "BOLT")]
    assert catalogs.source_name(None) == catalogs.source_name("Postgres") == "postgresql"
    with pytest.raises(ValueError):
        catalogs.read_catalog(spark, "csv")

"""A whole quote, from the cells of its files to its results, files and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adjudicate, decide, export, ingest
from ..vocab import MatchingConfig
from .index import CatalogIndex
from .match import match_lines
from .stages import staged


@dataclass(frozen=True)
class Quote:
    """lines: request lines with line_id and their own cells (raw); results: their matches; warnings: (file, warning)."""

    lines: DataFrame
    results: DataFrame
    warnings: DataFrame

    def own_cells(self) -> DataFrame:
        """(line_id, header, text, col) of the lines' own cells."""
        return self.lines.select("line_id", F.explode("raw").alias("x")).select("line_id", "x.header", "x.text", "x.col")

    def full_file(self, width: int) -> DataFrame:
        """The input's own columns, the first `width` of them, with what was found."""
        return export.with_input_columns(export.full_rows(self.results), self.own_cells(), width)

    def order_file(self) -> DataFrame:
        return export.order_file_rows(self.results)

    def summary_file(self, maker: str = "") -> DataFrame:
        return export.csv_rows(self.results, maker)

    def documents(self) -> DataFrame:
        """One JSON document a line."""
        return export.json_rows(self.results)

    def summary(self) -> DataFrame:
        return decide.summary(self.results)

    def picked(self, picks: DataFrame) -> Quote:
        """The quote with manual picks (line_id, product_code)."""
        return Quote(self.lines, decide.selected(self.results, picks), self.warnings)

    def adjudged(self, products: DataFrame, opinions: DataFrame | None = None) -> DataFrame:
        """Second opinions on the lines that need one, checked against products (product_code) and families (record_type family)."""
        families = products.where("lower(record_type) = 'family'").selectExpr("coalesce(external_id, product_code) AS code") if "record_type" in products.columns else products.limit(0).selectExpr("product_code AS code")
        return adjudicate.adjudicated(self.results, products.selectExpr("product_code AS code"), families, opinions)


def _numbered(lines: DataFrame, customer: str | None) -> DataFrame:
    """Lines with a number each and the customer that asks."""
    return staged(ingest.with_customer(lines.withColumn("line_id", F.monotonically_increasing_id()), customer))


def quote_from_cells(cells: DataFrame, catalog: DataFrame | CatalogIndex, sales: DataFrame | None = None, customer: str | None = None, config: MatchingConfig = MatchingConfig()) -> Quote:
    """A quote of workbook cells (those of `sources.workbook.workbook_cells`). Lines with a bad quantity are matched, too; their error stays beside them."""
    lines = _numbered(ingest.quote_lines(cells), customer).withColumn("source_sheet", F.lit(None).cast("string"))
    if "sheet" in cells.columns:
        names = cells.groupBy("file").agg(F.min_by("sheet", "sheet_no").alias("name")).withColumnRenamed("file", "source_file")
        lines = lines.drop("source_sheet").join(names.withColumnRenamed("name", "source_sheet"), "source_file", "left")
    asked = lines.withColumnRenamed("part_number", "requested_part_number")
    columns = ["line_id", "source_file", "source_sheet", "source_row", "requested_description", "quantity", "requested_part_number", "customer_name", "error"]
    return Quote(lines, match_lines(asked.select(*columns), catalog, sales, config), ingest.cell_warnings(cells))


def quote_from_pages(pages: DataFrame, catalog: DataFrame | CatalogIndex, sales: DataFrame | None = None, customer: str | None = None, config: MatchingConfig = MatchingConfig()) -> Quote:
    """A quote of page texts (file, page, line_no, text)."""
    items = staged(ingest.page_lines(pages))
    lines = _numbered(items.withColumnRenamed("file", "source_file"), customer).withColumn("raw", F.expr("CAST(array() AS array<struct<col:int,header:string,text:string>>)"))
    columns = ["line_id", "source_file", "source_sheet", "source_row", "requested_description", "quantity", "customer_name"]
    return Quote(lines, match_lines(lines.select(*columns), catalog, sales, config), ingest.page_warnings(items))

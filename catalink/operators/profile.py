"""Profiles of sheets from their cells (file, row, col, value, kind and, if known, formula), as tables by file.

Cells are those of `sources.workbook.workbook_cells` of one sheet a file; what is said of a row counts its
cells, so every table is a grouping of cells, never a collected sheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ingest import is_total_row


def _filled(cells: DataFrame) -> DataFrame:
    return cells.where(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("value", F.when(F.col("kind") == "text", F.trim("value")).otherwise(F.col("value")))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(file, row, header_like, total, signature) of every row that isn't blank.

    A row is header-like if it has two cells or more, all texts of 80 characters at most and none twice;
    signature is what tells rows apart: its cells by column.
    """
    text = F.col("kind") == "text"
    short = text & (F.length("value") <= 80) & ~F.col("value").startswith("=")
    rows = _filled(cells).groupBy("file", "row").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(short).alias("short"), F.count_distinct(F.lower("value")).alias("values"), F.max(text & is_total_row(F.col("value"))).alias("total"),
        F.sort_array(F.collect_list(F.struct("col", "kind", "value"))).alias("signature"),
    )
    good = (F.col("n") >= 2) & (F.col("short") == F.col("n")) & (F.col("values") == F.col("n"))
    return rows.select("file", "row", good.alias("header_like"), "total", "signature")


def headers(cells: DataFrame) -> DataFrame:
    """(file, row) of the header rows: the first header-like one, and all that repeat it."""
    rows = sheet_rows(cells)
    first = rows.where("header_like").groupBy("file").agg(F.min_by("signature", "row").alias("signature"), F.min("row").alias("first"))
    return rows.join(first, ["file", "signature"]).where("row >= first").select("file", "row")


def _data(cells: DataFrame) -> DataFrame:
    """Cells behind the first header row; of a sheet without one behind its first row."""
    first = headers(cells).groupBy("file").agg(F.min("row").alias("header_row"))
    every = cells.select("file").distinct().join(first, "file", "left").select("file", F.coalesce("header_row", F.lit(1)).alias("header_row"))
    return cells.join(every, "file").where("row > header_row")


def sheet_profile(cells: DataFrame) -> DataFrame:
    """One row a file: used rows and columns, first header row, number of header, total, blank and data rows, duplicates and formulas."""
    used = _filled(cells).groupBy("file").agg(F.max("row").alias("used_rows"), F.max("col").cast("long").alias("used_columns"), F.count_distinct("row").alias("filled"))
    rows = sheet_rows(cells).groupBy("file").agg(F.count_if("total").alias("total_rows"))
    heads = headers(cells).groupBy("file").agg(F.min("row").alias("header_row"), F.count(F.lit(1)).alias("header_rows"))
    data = sheet_rows(_data(cells)).groupBy("file").agg(F.count(F.lit(1)).alias("data_rows"))
    twice = duplicate_rows(cells).groupBy("file").agg(F.sum(F.col("copies") - 1).alias("duplicate_rows"))
    behind = F.count_if(F.col("formula").isNotNull()) if "formula" in cells.columns else F.count_if(F.col("value").startswith("="))
    formulas = cells.groupBy("file").agg(behind.alias("formulas"))
    all_of = used.join(rows, "file", "left").join(heads, "file", "left").join(data, "file", "left").join(twice, "file", "left").join(formulas, "file", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return all_of.select("file", "used_rows", "used_columns", F.coalesce("header_row", F.lit(1)).alias("header_row"), zero("header_rows"), zero("total_rows"), (F.col("used_rows") - F.col("filled")).alias("blank_rows"), zero("data_rows"), zero("duplicate_rows"), zero("formulas"))


def column_types(cells: DataFrame) -> DataFrame:
    """(file, col, kind, n) over the data rows that aren't blank: how many cells of each kind a column has, `empty` for those it lacks; col null counts all columns (grouping sets)."""
    data = _filled(_data(cells))
    rows = data.groupBy("file").agg(F.count_distinct("row").alias("rows"))
    told = data.groupBy("file", "col", "kind").agg(F.count(F.lit(1)).alias("n"))
    wide = _filled(cells).groupBy("file").agg(F.max("col").alias("width")).select("file", F.explode(F.sequence(F.lit(1), "width")).alias("col"))
    have = told.groupBy("file", "col").agg(F.sum("n").alias("have"))
    empty = wide.join(rows, "file").join(have, ["file", "col"], "left").select("file", "col", F.lit("empty").alias("kind"), (F.col("rows") - F.coalesce("have", F.lit(0))).alias("n")).where("n > 0")
    every = told.unionByName(empty)
    return every.groupingSets([["file", "col", "kind"], ["file", "kind"]], "file", "col", "kind").agg(F.sum("n").alias("n"))


def duplicate_rows(cells: DataFrame) -> DataFrame:
    """(file, first_row, copies, rows) of data rows that are the same cell by cell."""
    rows = sheet_rows(_data(cells))
    same = rows.groupBy("file", "signature").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("first_row"), F.sort_array(F.collect_list("row")).alias("rows"))
    return same.where("copies > 1").select("file", "first_row", "copies", "rows")


def first_and_last(cells: DataFrame, head: int = 10, tail: int = 5) -> DataFrame:
    """(file, row, part, signature) of the first `head` and last `tail` data rows of each file."""
    rows = sheet_rows(_data(cells)).select("file", "row", "signature")
    order = Window.partitionBy("file")
    ahead = rows.withColumn("place", F.row_number().over(order.orderBy("row"))).where(F.col("place") <= head).withColumn("part", F.lit("head"))
    behind = rows.withColumn("place", F.row_number().over(order.orderBy(F.desc("row")))).where(F.col("place") <= tail).withColumn("part", F.lit("tail"))
    return ahead.unionByName(behind).select("file", "row", "part", "signature")

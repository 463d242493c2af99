"""Scans and row rules: catalog rows, quote cells and text lines become typed records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import canonical, code_as_given, fold, once, quantity

#: Header names of each field, best first.
ALIASES = {
    "description": ["name", "description", "product", "item", "material", "requested description", "product description", "desc", "line description"],
    "quantity": ["qty", "quantity", "qty.", "qty ordered", "order qty", "units", "qty units"],
    "part_number": [
        "part number", "part #", "part#", "part no", "part no.", "partnumber",
        "customer part number", "customer part#", "customer pn", "customer part",
        "vendor part number", "vendor part#", "vendor pn",
        "manufacturer part number", "manufacturer part#", "mpn",
        "item number", "item #", "item no", "catalog number", "catalog #", "sku",
    ],
}


def _compact(alias: str) -> str:
    return re.sub("[^a-z0-9]", "", alias)


def is_preferred(flag: Column) -> Column:
    return F.coalesce(F.lower(F.trim(flag)) == "preferred", F.lit(False))


def products(catalog: DataFrame) -> DataFrame:
    """Matchable catalog rows: a name other than blank or `-`, a product if a record type is stated. A column external_id names a row beside its code; without one the code does."""
    name = F.trim(F.coalesce("name", F.lit("")))
    rows = catalog.withColumn("name", name).where(~F.col("name").isin("", "-"))
    if "record_type" in catalog.columns:
        rows = rows.where(F.lower(F.trim("record_type")) == "product")
    order = F.trim("orderablepartnumber") if "orderablepartnumber" in catalog.columns else F.lit(None).cast("string")
    flag = is_preferred(F.col("preferredflag")) if "preferredflag" in catalog.columns else F.lit(False)
    own = F.coalesce(F.when(F.trim("external_id") != "", F.trim("external_id")), F.col("name")) if "external_id" in catalog.columns else F.col("name")
    return rows.select(
        F.coalesce("id", "productcode").alias("product_id"),
        own.alias("external_id"),
        F.col("name").alias("product_code"),
        "name",
        "description",
        "description2",
        F.when(order != "", order).alias("orderable"),
        flag.alias("preferred"),
    )


def sample_rows(catalog: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of the catalog by id."""
    return catalog.orderBy("id").limit(n)


def record_counts(catalog: DataFrame) -> DataFrame:
    """(kind, n): rows of each record type; those without one count as products."""
    kind = F.lower(F.trim(F.coalesce(F.when(F.trim("record_type") != "", F.col("record_type")), F.lit("product")))) if "record_type" in catalog.columns else F.lit("product")
    return catalog.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def with_copies(products: DataFrame, text: str = "description") -> DataFrame:
    """Adds copies: how many rows have the same canonical text; null for a blank one. Counted per text first, so a frequent text is one row of the join."""
    canonical_text = F.when(F.trim(text) != "", canonical(F.col(text)))
    rows = products.withColumn("canonical", canonical_text)
    counts = rows.where("canonical IS NOT NULL").groupBy("canonical").agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(counts, "canonical", "left").drop("canonical")


def with_customer(lines: DataFrame, customer: str | None) -> DataFrame:
    """Lines as asked by one customer."""
    return lines.withColumn("customer_name", F.lit(customer).cast("string"))


def rows_with_codes(catalog: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows whose code, name or either description is among codes (code): one semi-join per field, no OR-join."""
    keys = codes.select(F.col("code")).distinct()
    found = None
    for field in ("productcode", "name", "description", "description2"):
        part = catalog.join(keys, catalog[field] == keys["code"], "left_semi")
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["id"])


def record_class(code: Column, catalog_number: Column, description: Column, parent: Column) -> Column:
    """product, family or invalid by the code's prefix, the catalog number and which fields are filled."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    ours = F.coalesce(F.trim(code).startswith("NA1-"), F.lit(False))
    dash = F.trim(F.coalesce(catalog_number, F.lit(""))) == "-"
    return F.when(ours & ~dash & ~blank(catalog_number) & ~blank(description) & ~blank(parent), "product").when(~ours & dash & blank(description) & blank(parent), "family").otherwise("invalid")


def catalog_number(text: Column) -> Column:
    """What stands before the first ` - `; null where nothing does."""
    source = F.trim(F.coalesce(text, F.lit("")))
    head = F.trim(F.substring_index(source, " - ", 1))
    return F.when(F.contains(source, F.lit(" - ")) & ~head.isin("", "-"), head)


def header_text(name: Column) -> Column:
    return F.lower(fold(F.translate(F.coalesce(name, F.lit("")), "_-", "  ")))


def header_key(name: Column) -> Column:
    return F.regexp_replace(header_text(name), "[^a-z0-9]", "")


def is_total_row(text: Column) -> Column:
    return F.coalesce(text.rlike(vocab.TOTAL_ROW), F.lit(False))


def quantity_value(text: Column) -> Column:
    """A number from a cell: commas dropped, blank is null, what is no number is null as well (see bad_quantity)."""
    return F.trim(F.translate(text, ",", "")).try_cast("double")


def bad_quantity(text: Column) -> Column:
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & quantity_value(text).isNull()


def cell_text(value: Column, kind: Column) -> Column:
    """Cells as text: whole numbers without a point, dates by day, with their time unless it is midnight; others trimmed, blank ones empty."""
    number = value.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(F.trim(value))
    moment = value.try_cast("timestamp_ntz")
    midnight = (F.hour(moment) == 0) & (F.minute(moment) == 0) & (moment == F.date_trunc("second", moment).cast("timestamp_ntz")) & (F.second(moment) == 0)
    day = F.date_format(moment, "yyyy-MM-dd")
    dated = F.when(moment.isNull(), F.trim(value)).when(midnight, day).otherwise(F.regexp_replace(F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", ""))
    return F.coalesce(F.when(kind == "number", whole).when(kind == "date", dated).otherwise(F.trim(value)), F.lit(""))


def numbered_headers(headers: DataFrame) -> DataFrame:
    """Headers (file, col, name) with repeats told apart as `name (2)`."""
    n = F.row_number().over(Window.partitionBy("file", "name").orderBy("col"))
    return headers.withColumn("header", F.when(n > 1, F.concat(F.col("name"), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("name")))


def header_fields(cells: DataFrame) -> DataFrame:
    """For each file the header row within the first 20 rows and the column of each field, as (file, header_row, field, col).

    A row is a header if a cell names a description, or if, cells that name a quantity or a part number aside,
    one cell remains (or it has only one); the first such row counts. Of equal names the last cell counts.
    """
    known = [(f, i, form, key) for f, names in ALIASES.items() for i, a in enumerate(names) for form, key in enumerate((a, _compact(a)))]
    known = cells.sparkSession.createDataFrame(known, "field string, rank int, form int, key string")
    heads = cells.where("row <= 20").withColumn("name", F.trim("value")).where("name <> ''")
    heads = heads.groupBy("file", "row", "name").agg(F.max("col").alias("col"))
    # A header meets an alias as it is or, second, by its letters and digits.
    forms = F.posexplode(F.array(header_text(F.col("name")), header_key(F.col("name"))))
    hits = heads.select("file", "row", "col", forms.alias("form", "key")).where("key <> ''").join(F.broadcast(known), ["form", "key"])
    named = hits.groupBy("file", "row", "field").agg(F.min_by("col", F.struct("rank", "form", -F.col("col"))).alias("col"))
    fields = named.groupBy("file", "row").pivot("field", list(ALIASES)).agg(F.first("col"))
    every = heads.groupBy("file", "row").agg(F.sort_array(F.collect_set("col")).alias("cols"), F.count(F.lit(1)).alias("n"))
    rows = every.join(fields, ["file", "row"], "left")
    left = F.filter("cols", lambda x: ~x.eqNullSafe(F.col("quantity")) & ~x.eqNullSafe(F.col("part_number")))
    text = F.coalesce("description", F.when(F.size(left) == 1, F.get(left, F.lit(0))), F.when(F.col("n") == 1, F.get("cols", F.lit(0))))
    rows = rows.withColumn("description", text).where("description IS NOT NULL")
    first = rows.groupBy("file").agg(F.min_by(F.struct("row", *ALIASES), "row").alias("x")).select("file", "x.*")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("col")) for f in ALIASES)))
    return first.select("file", F.col("row").alias("header_row"), each.alias("x")).select("file", "header_row", "x.*").where("col IS NOT NULL")


def quote_lines(cells: DataFrame) -> DataFrame:
    """Quote lines of all files from their cells (file, row, col, value, kind).

    Below the header row, or in a file without one from its two columns of texts and numbers; without blank,
    total and repeated header rows. A missing quantity is that of a quantity phrase in the text; a quantity that
    is no number is named in error. raw holds the row's cells (header, text, col) under a header.
    """
    fields = header_fields(cells).groupBy("file", "header_row").pivot("field", list(ALIASES)).agg(F.first("col"))
    bare = headerless_files(cells).join(fields.select("file"), "file", "left_anti")
    fields = fields.unionByName(bare.select("file", F.lit(0).alias("header_row"), F.col("text_col").alias("description"), F.col("number_col").alias("quantity"), F.lit(None).cast("int").alias("part_number")))
    heads = cells.join(fields.select("file", F.col("header_row").alias("row")), ["file", "row"]).where("trim(value) <> ''").select("file", "col", F.trim("value").alias("name"))
    heads = numbered_headers(heads).select("file", "col", "header")
    body = cells.join(fields, "file").where("row > header_row").join(heads, ["file", "col"], "left").withColumn("text", cell_text(F.col("value"), F.col("kind")))
    at = lambda field: F.max(F.when(F.col("col") == F.col(field), F.col("text")))
    said = F.col("kind") == "text"
    again = (F.col("col") == F.col("quantity")) & said & header_text(F.col("value")).isin(ALIASES["quantity"])
    raw = F.sort_array(F.collect_list(F.when(F.col("header").isNotNull(), F.struct("col", "header", "text"))))
    rows = body.groupBy("file", "row").agg(at("description").alias("description"), at("quantity").alias("qty"), at("part_number").alias("part_number"), F.max(said & is_total_row(F.col("text"))).alias("total"), F.max(again).alias("again"), raw.alias("raw"))
    text = F.coalesce(code_as_given(F.col("description")), F.lit(""))
    rows = rows.withColumns({"description": text, "part_number": F.when(F.trim("part_number") != "", code_as_given(F.col("part_number")))})
    kept = rows.where(((F.col("description") != "") | F.col("part_number").isNotNull()) & ~F.col("total") & ~F.coalesce("again", F.lit(False)))
    number = F.coalesce(quantity_value(F.col("qty")), F.when(~bad_quantity(F.col("qty")), once(F.col("description"), quantity).cast("double")))
    error = F.when(bad_quantity(F.col("qty")), F.concat(F.lit("Invalid quantity on row "), F.col("row").cast("string")))
    return kept.select(F.col("file").alias("source_file"), F.col("row").alias("source_row"), F.col("description").alias("requested_description"), number.alias("quantity"), error.alias("error"), "part_number", "raw")


def headerless_files(cells: DataFrame) -> DataFrame:
    """Files whose first 20 rows, blank ones aside, hold exactly one text and one number in the same columns, at least twice: (file, text_col, number_col)."""
    shapes = cells.where("row <= 20").where(F.trim("value") != "").groupBy("file", "row").agg(
        F.max(F.when(F.col("kind") != "number", F.col("col"))).alias("text_col"),
        F.max(F.when(F.col("kind") == "number", F.col("col"))).alias("number_col"),
        F.count(F.lit(1)).alias("cells"),
    )
    odd = F.count_if(F.col("text_col").isNull() | F.col("number_col").isNull() | (F.col("cells") != 2)).alias("odd")
    both = [f(x).alias(f"{n}_{x}") for x in ("text_col", "number_col") for n, f in (("least", F.min), ("most", F.max))]
    told = shapes.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), odd, *both)
    good = told.where("rows >= 2 AND odd = 0 AND least_text_col = most_text_col AND least_number_col = most_number_col")
    return good.select("file", F.col("least_text_col").alias("text_col"), F.col("least_number_col").alias("number_col"))


#: Words that make a line of a page a header, if it has no other.
PAGE_HEADERS = ["DESCRIPTION", "QTY", "QUANTITY", "UNIT", "PRICE", "NOTES", "SPEC"]
#: Fixed value: a line that ends with a whole number.
TRAILING = r"^(.*\S)\s+(\d{1,3}(?:,\d{3})+|\d+)$"


def page_lines(lines: DataFrame) -> DataFrame:
    """Items from text lines (file, page, line_no, text): lines that every page has, headers, totals and page numbers dropped.

    A trailing whole number is the quantity; without one a quantity phrase in the line is. trailing tells which.
    Rows are numbered over all lines of a file that aren't blank.
    """
    rows = lines.withColumn("t", fold(F.col("text"))).withColumn("said", F.coalesce(F.col("t") != "", F.lit(False)))
    # All windows are of one file, so that a file's lines are dealt once.
    in_file, in_text = Window.partitionBy("file"), Window.partitionBy("file", "t")
    order = in_file.orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"number": F.sum(F.col("said").cast("int")).over(order).cast("int"), "place": F.dense_rank().over(in_file.orderBy("page"))})
    distinct = lambda over: F.max("place").over(over) - F.max(F.col("page").isNull().cast("int")).over(over)
    rows = rows.withColumn("pages", distinct(in_file)).where("said")
    rows = rows.withColumn("place", F.dense_rank().over(in_text.orderBy("page"))).withColumn("on", distinct(in_text))
    rows = rows.where("file IS NULL OR pages < 2 OR on < pages")
    header = F.forall(F.split(F.upper("t"), " "), lambda w: w.isin(PAGE_HEADERS))
    rows = rows.where((F.length("t") >= 2) & ~header & ~is_total_row(F.col("t")) & ~F.col("t").rlike(r"(?U)^\d+$"))
    tail = F.regexp_extract("t", TRAILING, 2)
    text = F.when(tail != "", F.regexp_extract("t", TRAILING, 1)).otherwise(F.col("t"))
    number = F.coalesce(quantity_value(F.when(tail != "", tail)), once(text, quantity).cast("double"))
    return rows.select("file", F.concat(F.lit("Page "), F.col("page").cast("string")).alias("source_sheet"), F.col("number").alias("source_row"), text.alias("requested_description"), number.alias("quantity"), (tail != "").alias("trailing"))


#: Warnings of a file.
NO_QUANTITIES = 'Could not detect a clear quantity column in "{}" -- quantities were inferred from line text where possible.'
NO_HEADER = 'No header row was found in "{}" -- Description and Quantity columns were inferred from the data.'
HEADER_AGAIN = '"{}" repeated a column header (e.g. "QTY") mid-file -- those rows were skipped as section labels, not line items.'


def _warned(files: DataFrame, text: str) -> DataFrame:
    before, after = text.split("{}")
    return files.select("file", F.concat(F.lit(before), F.col("file"), F.lit(after)).alias("warning"))


def page_warnings(items: DataFrame) -> DataFrame:
    """(file, warning) of files whose `page_lines` have no trailing number."""
    return _warned(items.groupBy("file").agg(F.max("trailing").alias("any")).where("NOT any"), NO_QUANTITIES)


def cell_warnings(cells: DataFrame) -> DataFrame:
    """(file, warning) of files without a header row whose columns were inferred, and of files that repeat a header among their lines."""
    fields = header_fields(cells)
    bare = headerless_files(cells).join(fields.select("file").distinct(), "file", "left_anti")
    quantities = fields.where("field = 'quantity'").select("file", "header_row", "col")
    again = cells.join(quantities, ["file", "col"]).where((F.col("row") > F.col("header_row")) & (F.col("kind") == "text") & header_text(F.col("value")).isin(ALIASES["quantity"]))
    return _warned(bare.select("file"), NO_HEADER).unionByName(_warned(again.select("file").distinct(), HEADER_AGAIN))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, missing, distinct values and the longest text, in one pass."""
    stats = [x for c in df.columns for x in (F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"{c}|missing"), F.count_distinct(c).alias(f"{c}|values"), F.max(F.length(F.col(c).cast("string"))).alias(f"{c}|longest"))]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *stats)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"`{c}|missing`").alias("missing"), F.col(f"`{c}|values`").alias("values"), F.col(f"`{c}|longest`").cast("long").alias("longest")) for c in df.columns)))
    return one.select(each.alias("x")).select("x.*")

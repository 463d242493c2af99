"""Result tables and files: summary rows, order rows, full results with the input's own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import percent_text
from .decide import confidence_word, top_string

#: The map column of cells that have no column of their own.
OTHER_CELLS = "other_cells"
MATCHED = ("EXACT_MATCH", "HIGH_CONFIDENCE", "CONFIDENT_MATCH")


def order_rows(results: DataFrame) -> DataFrame:
    """Matched lines as order positions: orderable number, else code, and the quantity asked (null where none is); without either number a line is left out."""
    item = F.coalesce(F.when(F.col("matched_orderable") != "", F.col("matched_orderable")), F.when(F.col("matched_part") != "", F.col("matched_part")))
    return results.where(F.col("status").isin(*MATCHED)).select("line_id", item.alias("item"), "quantity").where("item IS NOT NULL")


def order_file_rows(results: DataFrame) -> DataFrame:
    """The two text columns of an order file; a missing quantity is blank."""
    return order_rows(results).select(F.col("item").alias("Part Number"), F.coalesce(number_text(F.col("quantity")), F.lit("")).alias("Quantity"))


def number_text(value: Column) -> Column:
    """A quantity as text: whole ones without a point."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def csv_rows(results: DataFrame, maker: str = "") -> DataFrame:
    """The 18 text columns of the summary file; maker stands in the names of three of them. Missing input columns are empty, missing scores N/A."""

    def given(name: str) -> Column:
        return F.col(name).cast("string") if name in results.columns else F.lit(None).cast("string")

    shown = lambda name: percent_text(F.col(name)) if name in results.columns else F.lit("N/A")
    plain = lambda name: F.when(F.col(name).isNotNull(), percent_text(F.col(name)))
    reason = F.array_join("reasons", "; ") if "reasons" in results.columns else F.lit("")
    text = F.get("candidates", F.lit(0))["description"]
    whose = f"Matched {maker} " if maker else "Matched "
    columns = {
        "Source File": given("source_file"),
        "Source Sheet": given("source_sheet"),
        "Source Row": given("source_row"),
        "Requested Description": given("requested_description"),
        "Quantity": number_text(F.col("quantity")) if "quantity" in results.columns else given("quantity"),
        f"{whose}Part Number": given("matched_part"),
        "Matched Identifier": given("matched_orderable"),
        f"{whose}Description": F.when(F.col("matched_part").isNotNull(), text),
        "Matching Percentage": plain("percentage"),
        "Confidence": confidence_word(F.col("status")),
        "Match Status": given("status"),
        "Match Reason": reason,
        "Candidate Count": given("candidate_count"),
        "Top Candidates": top_string(F.col("candidates")),
        "Requested Part Number": given("requested_part_number"),
        "Part Number Match %": shown("part_number_score"),
        "Description Match %": shown("description_score"),
        "Overall Match %": plain("percentage"),
    }
    return results.select(*(F.coalesce(c, F.lit("")).alias(n) for n, c in columns.items()))


#: Columns that a full result adds to the input's own.
ADDED = ["Status", "1st Top Product", "2nd Top Product", "3rd Top Product", "4th Top Product", "5th Top Product", "Matched Part Number", "Orderable Part Number"]


def full_rows(results: DataFrame) -> DataFrame:
    """line_id, requested_description, quantity and the columns ADDED: the status (a review reads Validation Required), the best five numbers, and the match's."""
    part = lambda i: F.get("candidates", F.lit(i))
    some = lambda x: F.when(x != "", x)
    code = lambda i: F.coalesce(some(part(i)["orderable"]), part(i)["product_code"], F.lit(""))
    label = F.when(F.upper("status") == "REVIEW_REQUIRED", "Validation Required").otherwise(F.coalesce("status", F.lit("")))
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    added = [label, *(code(i) for i in range(5)), blank("matched_part"), blank("matched_orderable")]
    return results.select("line_id", "requested_description", "quantity", *(x.alias(n) for x, n in zip(added, ADDED, strict=True)))


def with_input_columns(full: DataFrame, raw: DataFrame, width: int) -> DataFrame:
    """The columns ADDED of full_rows behind the input's own cells (line_id, header, text, col), in order of first appearance.

    The first `width` headers become columns; cells under any other stand in the map column OTHER_CELLS, which
    is always there. A line without cells shows its text and quantity under `Requested Description` and `Quantity`.
    """
    bare = full.join(raw.select("line_id").distinct(), "line_id", "left_anti").select("line_id", F.explode(F.array(
        F.struct(F.lit("Requested Description").alias("header"), F.coalesce("requested_description", F.lit("")).alias("text"), F.lit(0).alias("col")),
        F.struct(F.lit("Quantity").alias("header"), F.coalesce(number_text(F.col("quantity")), F.lit("")).alias("text"), F.lit(1).alias("col")),
    )).alias("x")).select("line_id", "x.*")
    cells = raw.select("line_id", "header", "text", "col").unionByName(bare)
    first = cells.groupBy("header").agg(F.min(F.struct("line_id", "col")).alias("at")).orderBy("at", "header").limit(width)
    headers = [r.header for r in first.collect()]
    each = cells.groupBy("line_id", "header").agg(F.min_by("text", "col").alias("text"))
    held = each.groupBy("line_id").agg(F.map_from_entries(F.collect_list(F.struct("header", F.coalesce("text", F.lit("")).alias("text")))).alias("cells"))
    known = F.array(*(F.lit(h) for h in headers)) if headers else F.array().cast("array<string>")
    kept = [F.coalesce(F.try_element_at("cells", F.lit(h)), F.lit("")).alias(h) for h in headers]
    rest = F.map_filter("cells", lambda k, _: ~F.array_contains(known, k)).alias(OTHER_CELLS)
    return full.join(held, "line_id", "left").select(*kept, rest, *(F.col(f"`{c}`") for c in ["line_id", *ADDED]))


def write_csv(rows: DataFrame, path: str, mark: bool = True) -> None:
    """Quoted only as needed, quotes doubled, blanks kept, CRLF line ends, a header in each file, by default after a byte order mark; maps as JSON."""
    rows = rows.select(*(F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in rows.schema))
    if mark:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    options = {"header": True, "lineSep": "\r\n", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(path)


def json_rows(results: DataFrame) -> DataFrame:
    """One JSON document a line, missing values as null."""
    return results.select("line_id", F.to_json(F.struct(*(F.col(f"`{c}`") for c in results.columns)), {"ignoreNullFields": "false"}).alias("json"))

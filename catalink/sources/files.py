"""Files and documents that bring request lines: digests, what is accepted, and JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The greatest file accepted, and why others are refused.
MOST_BYTES = 5 * 1024 * 1024
OLD_FORMAT = "Excel .xls files are not supported. Upload an .xlsx workbook."
OTHER_FORMAT, EMPTY, TOO_LARGE = "Only .xlsx or .pdf quote files are accepted.", "Uploaded file is empty.", "Quote file exceeds the maximum allowed size."
#: A document of request lines.
LINE = "struct<source_file:string,source_sheet:string,source_row:long,requested_description:string,quantity:double,requested_part_number:string>"
PAYLOAD = f"lines array<{LINE}>, source_path string, use_ai boolean, customer_name string, _corrupt_record string"


def digests(files: DataFrame) -> DataFrame:
    """(path, sha256, length) of files (path, content), as the binaryFile source gives them."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("length"))


def accepted(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files with refused: why a file isn't taken, and null for those that are. Only names and lengths are read, where the source has them. Spark's binaryFile leaves empty files out by itself."""
    size = F.col("length") if "length" in files.columns else F.octet_length("content")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    why = F.when(suffix == ".xls", OLD_FORMAT).when(~suffix.isin(".xlsx", ".pdf"), OTHER_FORMAT).when(F.coalesce(size, F.lit(0)) == 0, EMPTY).when(size > most_bytes, TOO_LARGE)
    return files.withColumn("refused", why)


def payload_lines(payloads: DataFrame) -> DataFrame:
    """Request lines of JSON documents (payload_id, body): payload_id, place, the line's fields, customer_name, source_path, error.

    A document that isn't JSON, or has neither lines nor a source path, and a line without a description give a row
    with an error instead of a line; a document with a source path gives one row that names it, whatever its lines.
    """
    said = F.from_json("body", PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = payloads.select("payload_id", said.alias("x")).select("payload_id", "x.*")
    broken = F.col("_corrupt_record").isNotNull() | (F.col("lines").isNull() & F.col("source_path").isNull() & F.col("customer_name").isNull() & F.col("use_ai").isNull())
    path = F.when(F.col("source_path") != "", F.col("source_path"))
    error = F.when(broken, "not a JSON document of lines").when(path.isNull() & (F.coalesce(F.size("lines"), F.lit(0)) <= 0), "Provide lines or source_path")
    none = F.expr(f"CAST(array() AS array<{LINE}>)")
    alone = error.isNotNull() | path.isNotNull()
    rows = rows.select("payload_id", "customer_name", path.alias("source_path"), error.alias("error"), F.when(alone, none).otherwise(F.coalesce("lines", none)).alias("lines"))
    each = rows.select("payload_id", "customer_name", "source_path", "error", F.posexplode_outer("lines").alias("place", "line"))
    blank = lambda name: F.coalesce(F.col(f"line.{name}"), F.lit(""))
    text = F.col("line.requested_description")
    missing = F.col("place").isNotNull() & (F.coalesce(F.length(text), F.lit(0)) == 0)
    return each.select(
        "payload_id", "place", F.when(F.col("place").isNotNull(), blank("source_file")).alias("source_file"), F.when(F.col("place").isNotNull(), blank("source_sheet")).alias("source_sheet"), F.when(F.col("place").isNotNull(), F.coalesce("line.source_row", F.lit(0))).alias("source_row"),
        text.alias("requested_description"), F.col("line.quantity").alias("quantity"), F.col("line.requested_part_number").alias("requested_part_number"), "customer_name", "source_path", F.coalesce("error", F.when(missing, "requested_description is empty")).alias("error"),
    )

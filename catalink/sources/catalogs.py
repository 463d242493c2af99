"""Where the catalog comes from: a database, Parquet, or workbooks; the columns are those of `ingest.products`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workbook import catalog_rows, workbook_cells, workbook_files

#: Names of a catalog's columns here, and under which a source may hold them.
COLUMNS = ("id", "productcode", "name", "description", "description2", "record_type", "orderablepartnumber", "preferredflag", "external_id")
DATABASES = ("postgresql", "postgres")


def source_name(value: str | None) -> str:
    """A source's plain name; none means the database."""
    name = (value or DATABASES[0]).strip().lower()
    return DATABASES[0] if name in DATABASES else name


def with_catalog_columns(rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """rows with the columns COLUMNS as text: those it has (under other names if names says so), and null for required ones that it lacks."""
    held = {c: (names or {}).get(c, c) for c in COLUMNS}
    needed = COLUMNS[:5]
    kept = [F.col(f"`{held[c]}`").cast("string").alias(c) if held[c] in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS if held[c] in rows.columns or c in needed]
    return rows.select(*kept)


def read_catalog(spark: SparkSession, source: str | None, path: str | None = None, names: dict[str, str] | None = None, **options: str) -> DataFrame:
    """The catalog of a source: postgresql (options of the jdbc source; partitionColumn and its bounds split the read), parquet (path), excel (a folder of workbooks)."""
    name = source_name(source)
    if name == DATABASES[0]:
        return with_catalog_columns(spark.read.format("jdbc").options(**options).load(), names)
    if name == "parquet":
        return with_catalog_columns(spark.read.parquet(path), names)
    if name == "excel":
        return with_catalog_columns(catalog_rows(workbook_cells(workbook_files(spark, path))), names)
    raise ValueError(f"no catalog source {name!r}")

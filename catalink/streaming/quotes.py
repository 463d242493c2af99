"""Request lines as a stream: each line is matched on its own, so no state or watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import products
from ..plans.index import CatalogIndex, catalog_index
from ..plans.match import match_lines
from ..vocab import MatchingConfig

LINES = "line_id bigint, requested_description string, quantity double, customer_name string, requested_part_number string"


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files of request lines as they arrive."""
    return spark.readStream.schema(LINES).json(folder)


def match_stream(lines: DataFrame, catalog: DataFrame | CatalogIndex, target: str, checkpoint: str, sales: DataFrame | None = None, config: MatchingConfig = MatchingConfig()) -> StreamingQuery:
    """Match every micro-batch against the catalog's index, made once, and write the results as Parquet, by batch so that a retried batch replaces itself."""
    index = catalog if isinstance(catalog, CatalogIndex) else catalog_index(products(catalog))

    def handle(batch: DataFrame, number: int) -> None:
        match_lines(batch, index, sales, config).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

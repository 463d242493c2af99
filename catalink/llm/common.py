"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"

RECORDS = 1000
#: Counts of so many labels at most are sent to all executors.
FEW_LABELS = 1000
#: Bounds of a labelled sample over all its labels, in expectation.
SAMPLE_BYTES, SAMPLE_ROWS = 64 << 20, 64_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set here only where it is unset and all tasks run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
        found = LOCAL_CHECKPOINTS
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/catalink/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_records(spark: SparkSession) -> None:
    """Arrow batches of RECORDS rows at most from now on: texts may be long, and a batch is held whole on both sides."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > RECORDS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(RECORDS))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns (new=old), found by position so that clashing names don't matter."""
    few_records(df.sparkSession)
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"c{names.index(old)}").alias(new) for new, old in columns.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    return (id_crc(doc_id) % 5) == 0


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-rows // per_part))


def ids_crc(ids: np.ndarray) -> int:
    """crc32 of token ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about most_bytes of text, so that memory is bounded whatever the texts' lengths."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def labelled_sample(rows: DataFrame, label: str, per_label: int, text: str | None = None, most_bytes: int = SAMPLE_BYTES, most_rows: int = SAMPLE_ROWS, seed: str = "sample") -> DataFrame:
    """About per_label rows (doc_id and others) of each label value, chosen by a hash of doc_id: the same at every run.

    Over all labels the sample has about most_rows rows and, if text is named, most_bytes bytes of text at most in
    expectation, each label an equal part of them, so its size is bounded whatever the table's, the number of
    labels and the texts' lengths.
    """
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)
    counts = rows.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("rows"), size.alias("bytes"))
    few = counts.limit(FEW_LABELS + 1).collect()
    labels = len(few) if len(few) <= FEW_LABELS else counts.count()
    if len(few) <= FEW_LABELS:
        counts = F.broadcast(rows.sparkSession.createDataFrame(few, counts.schema))
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    over = F.greatest(F.col("rows") / per_label, F.col("rows") * labels / most_rows, F.col("bytes") * labels / most_bytes)
    held = rows.join(counts.select("l", over.alias("n")), F.col(label) == F.col("l")).where(share * F.col("n") < 1)
    return held.select(*rows.columns)

"""Stage boundaries: a result written to the shared checkpoint folder, so that later filters are not pushed into (and copied over) long expressions, and a lost executor costs one stage only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all tasks run in one process, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return LOCAL_CHECKPOINTS


#: Rows of a partition that is dealt anew: as few as ROWS, in SHARES partitions a core at most, until these hold MANY rows each.
ROWS, SHARES, MANY = 500, 8, 20_000


def parts(df: DataFrame, rows: int) -> int:
    """In how many partitions rows of long expressions are dealt: enough for all cores, and no more tasks and files than that until they would grow large."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(-(-rows // ROWS), SHARES * cores), -(-rows // MANY))


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores: a table of few bytes is one or two splits, whatever its rows cost."""
    return df.repartition(SHARES * df.sparkSession.sparkContext.defaultParallelism)


def kept_together(df: DataFrame, *keys: str) -> DataFrame:
    """df with the rows of equal keys in one partition, in as many partitions as its rows call for (see `parts`): what is exploded and grouped by these keys behind it needs no other shuffle, and a task's memory doesn't grow with the table."""
    return df.repartition(parts(df, df.count()), *keys)


def staged(df: DataFrame, dealt: bool = False) -> DataFrame:
    """df, computed and written. dealt: in partitions of few rows (see `parts`); lines are few bytes but long expressions, and adaptive execution would merge them into one task."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    done = df.checkpoint()
    return done.repartition(parts(done, done.count())) if dealt else done

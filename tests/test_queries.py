"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import SparkSession

from catalink.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return f"{float(value):.6g}" if isinstance(value, float) else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, tables, name):
    found = QUERIES[name](spark, DATA)
    expected = tables.execute(ORACLE_SQL[name])
    assert _rows(found.columns, found.collect()) == _rows([c[0] for c in expected.description], expected.fetchall())


def test_without_sql(spark):
    from difflib import SequenceMatcher

    for row in QUERIES["c3_sequence_ratio"](spark, DATA).collect():
        assert row.fuzzy == pytest.approx(100 * SequenceMatcher(None, row.left, row.right).ratio(), abs=1e-3)


def test_entry_can_be_imported_without_a_session():
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], timeout=120).returncode == 0

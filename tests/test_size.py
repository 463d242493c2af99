"""Rules and queries whose cost or result depended on the number of rows, hits or uses of a text."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from catalink.functions import text as T
from catalink.functions import units as U
from catalink.operators import history, ingest, retrieve, score
from catalink.operators.ingest import products
from catalink.plans import match
from catalink.plans.index import catalog_index, drop_index
from catalink.queries import ORACLE_SQL, QUERIES
from catalink.queries_sources import book
from catalink.sources import adapters as A
from catalink.sources import workbook


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def _parts(tmp_path, keys):
    rows = ", ".join(f"({k}, '{n}', 'Brand#7', '{t}', {s}, 1.0)" for k, n, t, s in keys)
    duckdb.execute(f"COPY (SELECT p_partkey::bigint AS p_partkey, p_name, p_brand, p_type, p_size::int AS p_size, p_retailprice::double AS p_retailprice FROM (VALUES {rows}) x(p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    return str(tmp_path)


def _as_sql_says(spark, name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found, told = QUERIES[name](spark, folder), con.execute(ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    return Counter(map(tuple, found.select(*names).collect())) == Counter(told.fetchall())


def test_routes_of_more_rows_than_codes_have_digits_for(spark, tmp_path):
    folder = _parts(tmp_path, [(100002 * f + k, "old ring", "LARGE", 5) for f in (1, 10) for k in range(6)])
    assert _as_sql_says(spark, "d6_routes", folder, "part")


def test_trigrams_count_equal_texts_once(spark, tmp_path):
    """Keys of seven digits are cut to six, so three of four parts have one text: three rows and one text for its trigrams."""
    folder = _parts(tmp_path, [(k, "old ring", "LARGE", 5) for k in (100001, 1000011, 1000012, 1000021)])
    assert _as_sql_says(spark, "t2_index", folder, "part")
    index = catalog_index(products(A.catalog(spark, folder)))
    held = {r.gram: (r.rows, r.texts) for r in index.counted("text").collect()}
    assert held["old"] == (4, 2) and held["001"] == (3, 1) and held["002"] == (1, 1)
    drop_index(index)


@pytest.mark.parametrize(("rule", "most"), [
    (lambda t: U.dimensions(t), 1), (lambda t: U.dimension_status(U.dimensions(t), U.dimensions(t)), 2), (lambda t: U.dimension_words(t), 3), (lambda t: U.said(t), 2),
    (lambda t: U.unit_words(t), 3), (lambda t: T.reduce_category(U.dimensions(t)["key"], T.bare_category(U.dimensions(t)["key"])), 2), (lambda t: score.attributes(U.dimensions(t)["key"], U.voltages(t), U.dimensions(t), U.amperages(t)), 2),
])
def test_a_text_is_searched_once_for_sizes(spark, rule, most):
    """The pattern of sizes stands in a plan once for each search."""
    plan = spark.range(1).selectExpr("cast(id AS string) AS t").select(rule(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("FOOT|FT)(?![A-Z0-9])") <= most


def test_marks_within_a_text_are_no_hits(spark):
    rows = spark.createDataFrame([("\x01 3/4 in \x02 2 ft \x01",)], "t string")
    assert [x["key"] for x in rows.select(U.dimensions(F.col("t")).alias("x")).first()["x"]] == ["0.750000IN", "2.000000FT"]
    assert rows.select(U.dimension_words(F.col("t")).alias("x")).first()["x"] == "\x01 0.75 IN \x02 2 FT \x01"


def test_workbooks_are_written_in_linear_time():
    begin = time.process_time()
    content = book([(r, col, "i", f"{r}") for r in range(1, 20_001) for col in (2, 1)])
    assert time.process_time() - begin < 5
    assert [x[2:5] for x in workbook.cells(content)][-1] == (20_000, 2, "20000")


def test_lines_of_one_pool_are_looked_up_once(spark):
    """Pools of many lines: the results of `purchases` over the listed pool, without a join of all lines with all codes."""
    sales = spark.createDataFrame([(k % 7, k % 3, f" AB*nation_{k % 4}", f"C{k % 11} ", k % 5 - 1) for k in range(300)] + [(None, None, None, "C1", 9)], "shipto long, billto long, billtoname string, itemnumber string, orderquantity long")
    who = ["3", "2", "9", "ab*NATION_1", "*nation", "none", " ", None, "99999999999999999999"]
    lines = spark.createDataFrame([(i, who[i % len(who)], f"p{i % 3}") for i in range(54)], "line_id long, customer_name string, pool string")
    goods = spark.createDataFrame([(f"p{k % 3}", f"C{k % 11}") for k in range(40) if k % 4], "pool string, code string")
    listed = lines.join(goods, "pool").where("customer_name NOT LIKE '9999%'")
    told = history.shares(history.purchases(listed, sales))
    found = history.pooled_purchases(lines, goods, sales)
    rows = lambda df: Counter((r.line_id, r.code, r.quantity, round(r.share, 9)) for r in df.collect())
    assert rows(found) == rows(told) and len(rows(found)) > 50
    seen = found._jdf.queryExecution().optimizedPlan().toString()
    assert seen.count("Join") <= 4


def test_rows_of_the_same_words_fit_alike(spark):
    """Fitting rows are those of all pairs; rows are listed by sets of held words, and texts are sought only for positions with short spellings."""
    rng = random.Random(2)
    words = ["large", "ring", "bolt", "steel", "x7", "33", "widget", "promo", "a"]
    goods = [(str(i), f"N{i}", " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=2))) for i in range(120)]
    catalog = spark.createDataFrame(goods, "id string, name string, description string, description2 string").withColumns({"productcode": F.col("id"), "external_id": F.concat(F.lit("NA1-"), "name")})
    index = catalog_index(products(catalog))
    asked = spark.createDataFrame([(i, " ".join(rng.sample(words, k=rng.randint(1, 5)))) for i in range(40)] + [(99, "large ring promo")], "line_id long, query string")
    texts = {r.product_id: r.search_text for r in index.search.collect()}
    expected = set()
    for r in retrieve.with_groups(asked).collect():
        n = len(r.groups)
        for p, text in texts.items():
            held = sum(any(v in text for v in g) for g in r.groups)
            if n and (held == n or n >= 3 and math.ceil(0.6 * n) <= held):
                expected.add((r.line_id, p, n, held, 0 if held == n else 1))
    found = retrieve.fitting_rows(asked, index).select("line_id", "product_id", "positions", "held", "tier").collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == expected and {r.tier for r in found} == {0, 1}
    told = retrieve.fitting_rows(asked.where("line_id = 99"), index)
    assert "Contains(" not in told._jdf.queryExecution().optimizedPlan().toString()
    drop_index(index)


def test_equal_lines_and_rows_are_compared_once(spark):
    """The rule is not part of the join that gives lines and rows their results."""
    rows = spark.range(200).select(F.col("id").alias("product_id"), F.split(F.when(F.col("id") % 2 == 0, "LARGE STEEL RING").otherwise("SMALL BRASS BOLT"), " ").alias("tokens"), U.voltages(F.lit("")).alias("volts"))
    found = retrieve.description_candidates(rows.withColumnRenamed("product_id", "line_id"), rows)
    assert found.count() == 2 * 100 * 100
    assert "array_contains" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["p7_headerless", "p14_page_lines"])
def test_lines_of_files_are_dealt_once(spark, tmp_path, name):
    """One shuffle of whole files before their cells or lines are listed, in more partitions than the one file of the table has."""
    folder = _parts(tmp_path, [(k, "old ring", "LARGE", 5) for k in range(2000)])
    found = QUERIES[name](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert _as_sql_says(spark, name, folder, "part")


def test_lines_of_every_page_go(spark):
    """By the distinct pages of a file, blank lines included; a file of one page and lines without a file lose none."""
    rows = [("a", 1, 1, "HEAD"), ("a", 1, 2, "bolt 3"), ("a", 2, 1, " head"), ("a", 2, 2, "HEAD "), ("b", 1, 1, "HEAD"), ("b", 2, 1, " "), ("c", 1, 1, "HEAD"), ("c", 1, 2, "HEAD"), (None, 1, 1, "HEAD"), (None, 2, 1, "HEAD"), ("d", None, 1, "HEAD"), ("d", 1, 1, "HEAD")]
    found = ingest.page_lines(spark.createDataFrame(rows, "file string, page int, line_no int, text string")).collect()
    told = sorted((r.file or "", r.source_row, r.requested_description) for r in found)
    assert told == [("", 1, "HEAD"), ("", 2, "HEAD"), ("a", 2, "bolt"), ("a", 3, "head"), ("b", 1, "HEAD"), ("c", 1, "HEAD"), ("c", 2, "HEAD"), ("d", 1, "HEAD"), ("d", 2, "HEAD")]


def test_each_text_of_scores_is_prepared_once(spark, monkeypatch):
    """Many rows of few texts: the index and `field_scores` prepare the distinct texts alone, and the forms are those of `prepared` and `coded`."""
    goods = [(str(i), f"N{i % 3}", f"{i % 2 + 1}/4 in steel ring 120 volts", "AB-12 X") for i in range(60)]
    catalog = spark.createDataFrame(goods, "id string, name string, description string, description2 string").withColumns({"productcode": F.col("id"), "external_id": F.concat(F.lit("NA1-"), "name")})
    sizes, real = [], score.prepared
    monkeypatch.setattr(score, "prepared", lambda rows, *how: (sizes.append(rows.count()), real(rows, *how))[1])
    index = catalog_index(products(catalog))
    index.goods
    asked = index.search.select(F.col("product_id").alias("line_id"), F.col("description").alias("query"), F.col("description").alias("wide"))
    rows = match.field_scores(asked, index.search.select(F.col("product_id").alias("line_id"), "product_id"), index).select("score").collect()
    assert sizes and max(sizes) <= 12 and sum(sizes) <= 14 and len(rows) == 60 and {r.score for r in rows} == {100.0}
    monkeypatch.undo()
    given = index.search.select("product_id", "blob", "description2")
    made = score.with_forms(given, "product_id", {"b": "blob", "d2": "description2"}).collect()
    plain = given
    for prefix, text in (("b", "blob"), ("d2", "description2")):
        plain = score.coded(score.prepared(plain, text, prefix), text, prefix).withColumn(f"{prefix}_is_code", T.is_code_like(F.col(text)))
    told = {r.product_id: r.asDict(True) for r in plain.collect()}
    assert len(made) == 60 and all(r.asDict(True) == told[r.product_id] for r in made)
    drop_index(index)


@pytest.mark.parametrize("name", ["d4_decided", "d5_named"])
def test_decided_lines_are_not_broadcast(spark, tmp_path, name):
    """Candidates are far larger than the table's file tells: no side of a join goes through the driver."""
    folder = _parts(tmp_path, [(k, "old ring", "LARGE", 5) for k in range(64)])
    found = QUERIES[name](spark, folder)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert _as_sql_says(spark, name, folder, "part")


@pytest.mark.parametrize("few", [0, 12, 1000])
def test_identifiers_of_the_same_words_are_searched_once(spark, monkeypatch, few):
    """The first rows by code of all that hold each word, whether words are rare or common; equal lists of words are ranked once."""
    monkeypatch.setattr(retrieve, "FEW", few)
    rng = random.Random(4)
    words = ["ring", "bolt", "steel", "x7", "33", "widget"]
    goods = [(str(i), f"N{i}", " ".join(rng.choices(words, k=3)), "x") for i in range(90)]
    catalog = spark.createDataFrame(goods, "id string, name string, description string, description2 string").withColumns({"productcode": F.col("id"), "external_id": F.concat(F.lit("NA1-"), "name")})
    index = catalog_index(products(catalog))
    asked = [(i, " ".join(rng.sample(words, k=rng.randint(1, 3)))) for i in range(30)] + [(90, "n17"), (91, "n17 ring"), (92, "nothing ring"), (93, "ring bolt ring")]
    texts = sorted((r.product_code, r.product_id, r.identifier_search) for r in index.search.collect())
    told = {(i, p, n) for i, q in asked for n, (_, p, _) in enumerate([t for t in texts if all(w in t[2] for w in q.split())][:7], 1)}
    sizes, real = [], retrieve.staged
    monkeypatch.setattr(retrieve, "staged", lambda df, *how: (sizes.append(df.count()) if "least" in str(df._jdf.queryExecution().logical()) else None, real(df, *how))[1])
    found = retrieve.identifier_candidates(spark.createDataFrame(asked, "line_id long, query string"), index, 7).collect()
    assert len(found) == len(set(found)) and {(r.line_id, r.product_id, r.rank) for r in found} == told and len(told) > 100
    assert sizes and sizes[0] <= len({frozenset(q.split()) for _, q in asked})
    drop_index(index)

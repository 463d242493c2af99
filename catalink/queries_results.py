"""Queries of rules on texts, scores, decisions, opinions and exports, over values made from every part so that each branch occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import similarity as S
from .functions import text as T
from .functions import units as U
from .operators import decide, explain, export, ingest, score
from .plans.stages import spread
from .queries import _CASES, _FOUR, _cases, _four, _query
from .sources import adapters as A

c = F.col


def _part(spark, d, *columns: str):
    return spread(A.read(spark, d, "part")).selectExpr("p_partkey AS id", *columns)


# --- texts
_TRIGRAMS = "list_distinct(flatten(list_transform(string_split({x}, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@_query("k4_similarity", f"SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT p.p_partkey AS id, {_TRIGRAMS.format(x='p.p_name')} AS a, {_TRIGRAMS.format(x='''(c.p_name || ' ' || lower(c.p_type))''')} AS b FROM part p JOIN part c ON c.p_partkey = p.p_partkey + 1)")
def k4(spark, d):
    left = _part(spark, d, "p_name AS a")
    right = _part(spark, d, "p_name || ' ' || lower(p_type) AS b").withColumn("id", c("id") - 1)
    return left.join(right, "id").select("id", F.round(S.similarity(S.trigrams(c("a")), S.trigrams(c("b"))), 6).alias("similarity"))


@_query("f5_part_numbers", "SELECT p_partkey AS id, p_partkey % 3 <> 1 AS same, p_partkey % 3 = 0 AS looks, CASE WHEN p_partkey % 3 = 2 THEN 'K' || p_partkey || '-7' ELSE '' END AS bare FROM part")
def f5(spark, d):
    rows = _part(spark, d, "CASE p_partkey % 3 WHEN 0 THEN 'k' || p_partkey || '-7' WHEN 1 THEN 'other one' ELSE '\"NA1-k' || p_partkey || ' - 7\"' END AS a", "CASE p_partkey % 3 WHEN 2 THEN 'NA1-' ELSE '' END || 'K' || p_partkey || '-7' AS b")
    return rows.select("id", T.same_part(c("a"), c("b")).alias("same"), T.looks_like_part(c("a")).alias("looks"), T.without_prefix(c("a")).alias("bare"))


@_query("f43_spans", "SELECT id, string_agg(t, '|' ORDER BY length(t) DESC, place) AS spans FROM (SELECT p_partkey AS id, unnest(['AB', 'AB-' || p_partkey, 'AB-' || p_partkey || '/X', p_partkey::varchar, p_partkey || '/X', 'X', upper(split_part(p_name, ' ', 1))]) AS t, unnest([1, 1, 1, 2, 2, 3, 4]) AS place FROM part) GROUP BY id")
def f43(spark, d):
    text = "'AB-' || p_partkey || '/X, ' || upper(split_part(p_name, ' ', 1)) AS t"
    return _part(spark, d, text).select("id", F.array_join(F.transform(explain.identifier_spans(c("t")), lambda s: s["text"]), "|").alias("spans"))


@_query("k8_longest_first", "SELECT p_partkey AS id, 'AB-' || p_partkey || '-X' AS first FROM part")
def k8(spark, d):
    return _part(spark, d, "'see ' || 'Q' || ' AB-' || p_partkey || '-X' AS t").select("id", F.get(explain.identifier_spans(F.upper("t")), F.lit(0))["text"].alias("first"))


@_query("f2_normalized", "SELECT p_partkey AS id, upper(p_name) || ' AND 1.5 A/B C ' || p_size AS text FROM part")
def f2(spark, d):
    return _part(spark, d, "p_name || ' & 1.5, a / b - c (' || p_size || ')' AS t").select("id", T.normalize_text(c("t")).alias("text"))


@_query("p16_bad_quantity", "SELECT p_partkey AS id, p_partkey % 4 = 3 AS bad, CASE p_partkey % 4 WHEN 0 THEN 1000.0 + p_size WHEN 1 THEN p_size::double END AS quantity FROM part")
def p16(spark, d):
    rows = _part(spark, d, "CASE p_partkey % 4 WHEN 0 THEN '1,0' || lpad(cast(p_size AS string), 2, '0') WHEN 1 THEN ' ' || p_size WHEN 2 THEN '  ' ELSE p_name END AS t")
    return rows.select("id", ingest.bad_quantity(c("t")).alias("bad"), ingest.quantity_value(c("t")).alias("quantity"))


def _cells(spark, d):
    """Files of quote cells: two rows of preamble, a header, one row per part, a repeated header and a total."""
    head = [(f"f{i}", r, col, v, "text") for i in range(5) for r, col, v in ((1, 1, "QUOTE"), (1, 2, "of May"), (3, 1, "Catalog #"), (3, 2, "Product_Description"), (3, 3, "Order QTY"), (4, 2, "Description"), (4, 3, "Qty"), (5, 2, "Sub total"), (5, 3, "9"))]
    head = spark.createDataFrame(head, "file string, row long, col int, value string, kind string")
    body = A.read(spark, d, "part").selectExpr("concat('f', p_partkey % 5) AS file", "p_partkey + 10 AS row", "explode(array(named_struct('col', 1, 'value', concat('C', p_partkey), 'kind', 'text'), named_struct('col', 2, 'value', CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END, 'kind', 'text'), named_struct('col', 3, 'value', concat(p_size, '.0'), 'kind', 'number'))) AS x")
    return head.unionByName(body.select("file", "row", "x.*"))


@_query("s6_quote_lines", "SELECT 'f' || p_partkey % 5 AS source_file, p_partkey + 10 AS source_row, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS requested_description, p_size::double AS quantity FROM part")
def s6(spark, d):
    return ingest.quote_lines(_cells(spark, d)).select("source_file", "source_row", "requested_description", "quantity")


# --- measures and scores
@_query("n9_clamp", "SELECT p_partkey AS id, printf('%.4f', greatest(0.0::double, least(100.0::double, x)))::double AS value FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 999983 * 10 + 5) / 100000.0::double WHEN 1 THEN (p_partkey % 4096 - 64) / 32.0::double ELSE p_partkey % 1009 / 7.0::double END AS x FROM part)")
def n9(spark, d):
    x = "CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 999983 * 10 + 5) / 100000D WHEN 1 THEN (p_partkey % 4096 - 64) / 32D ELSE p_partkey % 1009 / 7D END AS x"
    return _part(spark, d, x).select("id", score.clamp(c("x")).alias("value"))


@_query("c12_numeric", "SELECT id, CASE WHEN list_contains(s, 'conflict') THEN 0.0::double WHEN list_contains(s, 'match') THEN 100.0::double END AS score, list_contains(s, 'conflict') AS conflict, CASE WHEN list_contains(s, 'conflict') THEN 'Conflict' WHEN list_contains(s, 'match') THEN 'Match' ELSE 'Not Found' END AS label FROM (SELECT p_partkey AS id, [['none', 'match', 'conflict'][p_partkey % 3 + 1], ['none', 'match', 'conflict'][p_partkey // 3 % 3 + 1], ['none', 'match', 'conflict'][p_partkey // 9 % 3 + 1]] AS s FROM part)")
def c12(spark, d):
    rows = _part(spark, d, "array('none', 'match', 'conflict') AS s", "cast(p_partkey % 3 AS int) AS a", "cast(p_partkey div 3 % 3 AS int) AS b", "cast(p_partkey div 9 % 3 AS int) AS e")
    x = U.numeric_component(*(F.get("s", c(i)) for i in "abe"))
    return rows.select("id", x.alias("x")).select("id", "x.*")


@_query("n7_overlap", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 OR p_size % 5 = 0 THEN 'none' WHEN p_partkey % 4 = p_size % 5 OR p_size % 5 = 4 THEN 'match' ELSE 'conflict' END AS state FROM part")
def n7(spark, d):
    rows = _part(spark, d, "filter(array(p_partkey % 4), x -> x <> 0) AS a", "CASE p_size % 5 WHEN 0 THEN array() WHEN 4 THEN array(1, 2, 3) ELSE array(p_size % 5) END AS b")
    return rows.select("id", U.overlap_status(c("a").cast("array<int>"), c("b").cast("array<int>")).alias("state"))


@_query("n7_voltage_state", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'none' WHEN p_partkey % 3 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'match' ELSE 'conflict' END ELSE CASE WHEN p_size % 2 = 0 THEN 'conflict' ELSE 'match' END END AS state FROM part")
def n7v(spark, d):
    rows = _part(spark, d, "CASE p_partkey % 3 WHEN 0 THEN 'no volts' WHEN 1 THEN '120 volts' ELSE '120 VAC' END AS a", "CASE WHEN p_size % 2 = 1 AND p_partkey % 3 = 1 THEN '240 VAC' WHEN p_size % 2 = 0 AND p_partkey % 3 = 2 THEN '120 VDC' ELSE '120 VAC' END AS b")
    return rows.select("id", U.voltage_status(U.voltages(c("a")), U.voltages(c("b"))).alias("state"))


@_query("n6_pairs_state", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'match' ELSE 'conflict' END AS state FROM part")
def n6(spark, d):
    rows = _part(spark, d, "CASE p_partkey % 3 WHEN 0 THEN p_name ELSE p_size || ' x 3 ' || p_name END AS a", "CASE p_partkey % 3 WHEN 2 THEN p_size || ' x 4' ELSE '9 x 9 or ' || p_size || ' X 3' END AS b")
    return rows.select("id", U.pair_status(U.number_pairs(c("a")), U.number_pairs(c("b"))).alias("state"))


@_query("c7_identifier", """SELECT id, kind, printf('%.4f', CASE kind WHEN 'exact' THEN 100.0 WHEN 'normalized_exact' THEN 100.0 WHEN 'partial' THEN least(78.0::double, 38.0::double + 42.0::double * 7 / length(code)) ELSE 0.0 END)::double AS score
    FROM (SELECT p_partkey AS id, 'ABC' || lpad(p_partkey::varchar, 7, '0') || 'X' AS code, ['exact', 'normalized_exact', 'partial', 'none'][p_partkey % 4 + 1] AS kind FROM part)""")
def c7(spark, d):
    code = "concat('ABC', lpad(cast(p_partkey AS string), 7, '0'), 'X')"
    asked = f"CASE p_partkey % 4 WHEN 0 THEN {code} WHEN 1 THEN concat('ABC-', substr({code}, 4)) WHEN 2 THEN substr({code}, 1, 7) ELSE 'QQ77' END AS asked"
    rows = _part(spark, d, f"{code} AS code", asked)
    rows = score.identity(score.coded(score.coded(rows, "asked", "q"), "code", "c"), "q", "c", "found")
    return rows.select("id", c("found.type").alias("kind"), c("found.score").alias("score"))


@_query("c9_confidence", f"""SELECT id, round(least(100, CASE WHEN con THEN least(40, lifted) ELSE lifted END), 2) AS value FROM (SELECT *, CASE WHEN known OR con THEN base ELSE greatest(base, t) END AS lifted FROM (SELECT *,
    CASE WHEN k = 0 THEN 100.0 WHEN k = 1 THEN least(78.0, CASE WHEN num IS NULL THEN 0.50 * e + 0.19 * f + 0.26 * t + 0.05 * a ELSE 0.50 * e + 0.15 * f + 0.20 * t + 0.05 * a + 0.10 * num END)
         WHEN f >= 90 THEN 100.0 WHEN num IS NULL THEN 0.5 * t + 0.5 * a ELSE 0.45 * t + 0.45 * a + 0.10 * num END AS base
    FROM (SELECT *, id % 4 AS k, id % 4 <= 1 AS known, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 0.0 ELSE 100.0 END AS num, id % 5 = 1 AS con FROM {_FOUR})))""")
def c9(spark, d):
    rows = _four(spark, d).selectExpr("*", "CASE id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'none' END AS k", "CASE WHEN id % 5 = 1 THEN 0D WHEN id % 5 <> 0 THEN 100D END AS num", "id % 5 = 1 AS con")
    return rows.select("id", F.round(score.confidence(c("k"), c("e"), c("f"), c("t"), c("a"), c("num"), c("con"), c("t"), F.lit(False)), 2).alias("value"))


@_query("c14_preference", f"SELECT id, CASE WHEN id % 4 = 0 THEN least(100.0, t + 5) ELSE t END AS value FROM {_FOUR}")
def c14(spark, d):
    return _four(spark, d).select("id", score.with_preference(c("t"), c("id") % 4 == 0).alias("value"))


@_query("c15_purchase_bonus", f"SELECT id, CASE WHEN a > 0 THEN printf('%.4f', least(100.0, t + 5 * (a / 128)))::double ELSE t END AS value FROM {_FOUR}")
def c15(spark, d):
    return _four(spark, d).select("id", score.with_purchases(c("t"), c("a") / 128).alias("value"))


_TAGS = {"a": "array('voltage:120', concat('token:', p_name), 'size:1.000000IN')", "b": "CASE p_partkey % 3 WHEN 0 THEN array('voltage:120', 'size:1.000000IN') WHEN 1 THEN array('voltage:240') ELSE array('token:X') END"}


@_query("c16_compatible", f"SELECT id, id % 3 = 1 OR (e < 100 AND t < 40) AS conflict, e >= 100 OR (NOT (id % 3 = 1 OR t < 40) AND t >= 50) AS compatible FROM {_FOUR}")
def c16(spark, d):
    rows = _four(spark, d).join(_part(spark, d, *(f"{v} AS tags_{k}" for k, v in _TAGS.items())), "id")
    conflict = explain.descriptions_conflict(c("tags_a"), c("tags_b"), F.lit(False), c("e"), c("t"))
    return rows.select("id", conflict.alias("conflict"), explain.descriptions_compatible(conflict, c("e"), c("t")).alias("compatible"))


# --- reasons and decisions
@_query("d7_code_reason", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Exact Productcode match' WHEN 1 THEN 'Productcode match with NA1 prefix equivalence' ELSE 'Normalized Productcode match' END AS reason FROM part")
def d7(spark, d):
    rows = _part(spark, d, "CASE p_partkey % 3 WHEN 0 THEN ' k' || p_partkey WHEN 1 THEN 'NA1-K' || p_partkey ELSE 'J' || p_partkey END AS asked", "'K' || p_partkey AS stored")
    return rows.select("id", explain.code_reason(c("asked"), c("stored")).alias("reason"))


_KINDS = "SELECT *, ['EXACT_MATCH', 'HIGH_CONFIDENCE', 'REVIEW_REQUIRED', 'NO_MATCH'][id % 4 + 1] AS state, CASE WHEN id % 11 <> 0 THEN t - s END AS gap FROM (" + _CASES + ")"


def _kinds(spark, d):
    return _cases(spark, d).selectExpr("*", "element_at(array('EXACT_MATCH', 'HIGH_CONFIDENCE', 'REVIEW_REQUIRED', 'NO_MATCH'), cast(id % 4 + 1 AS int)) AS state", "CASE WHEN id % 11 <> 0 THEN t - s END AS gap")


@_query("d9_result_reasons", f"""SELECT id, concat_ws('|', CASE state WHEN 'EXACT_MATCH' THEN 'Unique exact normalized description match' WHEN 'HIGH_CONFIDENCE' THEN concat_ws('|', 'Top candidate is above the high-confidence threshold', 'Score gap ' || printf('%.2f', gap) || ' is large enough to select a winner')
    WHEN 'REVIEW_REQUIRED' THEN CASE WHEN d THEN 'Multiple products have the same description|Insufficient information to choose a single part number' WHEN gap < 5 THEN 'Score gap ' || printf('%.2f', gap) || ' is below the configured separation 5.00' ELSE 'Good candidates exist but a unique winner was not established' END
    ELSE CASE WHEN n = 0 THEN 'No catalog product reached the candidate floor' ELSE 'Top score ' || printf('%.2f', t) || ' is below the minimum match threshold 5.00' END END, CASE WHEN u THEN 'Exactly one product shares this normalized description' END) AS reasons FROM ({_KINDS})""")
def d9(spark, d):
    reasons = explain.result_reasons(c("state"), c("u"), c("d"), c("t"), c("gap"), c("n"))
    return _kinds(spark, d).select("id", F.array_join(reasons, "|").alias("reasons"))


@_query("d10_breakdown", f"SELECT id, e AS productcode_score, t AS name_score, CASE WHEN id % 3 <> 0 THEN f ELSE 0.0 END AS description_score, a AS description2_score, t AS overall_score, 'why' AS match_reason, id % 2 = 0 AS numeric_conflict, CASE WHEN id % 5 = 0 THEN 'none' ELSE 'exact' END AS productcode_match_type FROM {_FOUR}")
def d10(spark, d):
    x = explain.breakdown(c("e"), c("t"), F.when(c("id") % 3 != 0, c("f")), c("a"), c("t"), F.lit("why"), F.when(c("id") % 2 == 0, True), F.when(c("id") % 5 != 0, "exact"))
    return _four(spark, d).select("id", x.alias("x")).select("id", "x.*")


@_query("d15_headline", f"""SELECT k.id, CASE WHEN k.id % 23 = 0 THEN 'User Selected Match' WHEN state = 'REVIEW_REQUIRED' AND (((gap IS NULL OR gap < 8) AND e > 0) OR i IN ('partial', 'exact')) THEN 'Multiple possible Productcode matches' WHEN i = 'partial' THEN 'Partial Productcode / Name Match'
    WHEN state = 'REVIEW_REQUIRED' THEN 'Multiple products have equivalent description matches' WHEN state = 'NO_MATCH' THEN 'No sufficiently similar product found' WHEN e >= 99.5 AND a >= 70 THEN 'Exact Productcode + Description Match' WHEN e >= 99.5 OR i = 'exact' THEN 'Exact Productcode Match'
    WHEN a >= 70 THEN 'Description Match' WHEN f >= 99.5 THEN 'Exact name Match' WHEN f >= 70 THEN 'name Match' WHEN f >= 40 AND a >= 40 THEN 'name + Description Match' WHEN f >= 40 THEN 'name Match' WHEN a >= 40 THEN 'Description Match' ELSE 'Catalog match' END AS headline FROM ({_KINDS}) k JOIN {_FOUR} f ON f.id = k.id""")
def d15h(spark, d):
    rows = _kinds(spark, d).join(_four(spark, d).select("id", "e", "f", "a"), "id")
    line = explain.headline(c("state"), c("i"), c("e"), c("f"), c("a"), c("s"), c("gap"), c("id") % 23 == 0, F.lit(False), F.lit(False))
    return rows.select("id", line.alias("headline"))


@_query("d15_contribution", f"SELECT id, CASE WHEN id % 7 = 0 THEN 'partial' WHEN t >= 99.5 THEN 'exact' WHEN t >= 70 THEN 'strong' WHEN t >= 40 THEN 'partial' ELSE 'none' END AS level, CASE WHEN id % 7 = 0 THEN 'Partial match' WHEN t >= 99.5 THEN 'Exact match' WHEN t >= 70 THEN 'Strong match' WHEN t >= 40 THEN 'Partial match' ELSE 'No match' END AS label, t AS score FROM {_FOUR}")
def d15c(spark, d):
    return _four(spark, d).select("id", explain.contribution(c("t"), c("id") % 7 == 0).alias("x")).select("id", "x.*")


@_query("d2_competing", "SELECT p_partkey AS id, p_partkey % 3 <> 2 AS competing FROM part")
def d2(spark, d):
    side = lambda end, extra: f"named_struct('query_compact', 'AB', 'catalog_compact', concat(CASE WHEN p_partkey % 3 = 0 THEN 'AB' ELSE 'Q' END, '{end}'), 'extra', CASE WHEN p_partkey % 3 = 1 THEN array('{extra}') ELSE cast(array() AS array<string>) END)"
    return _part(spark, d, f"{side('1', 'X')} AS a", f"{side('2', 'Y')} AS b").select("id", decide.competing(c("a"), c("b")).alias("competing"))


@_query("d11_line_key", A.cte("lines") + " SELECT line_id, concat(source_file, '|', source_sheet, '|', source_row, '|', requested_description) AS key FROM lines")
def d11(spark, d):
    return A.lines(spark, d).select("line_id", decide.line_key(c("source_file"), c("source_sheet"), c("source_row"), c("requested_description")).alias("key"))


# --- picks, opinions, exports: results with three candidates a line
_R = "SELECT p_partkey AS id, ['EXACT_MATCH', 'HIGH_CONFIDENCE', 'REVIEW_REQUIRED', 'NO_MATCH'][p_partkey % 4 + 1] AS state, p_partkey % 101 AS t, p_partkey % 5 = 0 AS tie FROM part"


def _results(spark, d):
    state = "element_at(array('EXACT_MATCH', 'HIGH_CONFIDENCE', 'REVIEW_REQUIRED', 'NO_MATCH'), cast(p_partkey % 4 + 1 AS int))"
    item = lambda rank, score_: f"named_struct('rank', {rank}, 'product_code', concat('K', p_partkey, '-{rank}'), 'product_id', concat('id', p_partkey, '-{rank}'), 'score', cast({score_} AS double), 'orderable', CASE WHEN {rank} = 2 THEN concat('ORD', p_partkey) END, 'description', concat(p_name, CASE WHEN {rank} = 2 THEN ' two' ELSE '' END), 'canonical', CASE WHEN p_partkey % (3 * {rank}) = 0 THEN 'SAME' ELSE 'C{rank}' END, 'reasons', array('why'))"
    items = f"array({item(1, 'p_partkey % 101')}, {item(2, 'CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 101 - 0.5 ELSE p_partkey % 101 - 3 END')})"
    matched = f"CASE WHEN {state} IN ('EXACT_MATCH', 'HIGH_CONFIDENCE') THEN concat('K', p_partkey, '-1') END AS matched_part"
    more = ["cast(null AS string) AS matched_description", "p_partkey % 8 = 0 AS part_number_match", "cast(p_partkey % 101 AS double) AS top_score", "cast(null AS string) AS match_type_label", "array('first', 'second') AS reasons"]
    return A.read(spark, d, "part").selectExpr("p_partkey AS line_id", "concat(p_name, ' ', p_partkey) AS requested_description", "CASE WHEN p_partkey % 3 = 0 THEN cast(p_size AS double) END AS quantity", f"{state} AS status", matched, "CASE WHEN p_partkey % 8 = 0 THEN concat('ORD', p_partkey) END AS matched_orderable", "cast(p_partkey % 101 AS double) AS percentage", f"CASE WHEN {state} = 'NO_MATCH' THEN filter({items}, x -> false) ELSE {items} END AS candidates", "2 AS candidate_count", *more)


@_query("a4_summary", f"SELECT count(*) AS total, count(*) FILTER (WHERE state IN ('EXACT_MATCH', 'HIGH_CONFIDENCE')) AS matched, count(*) FILTER (WHERE state = 'REVIEW_REQUIRED') AS review, count(*) FILTER (WHERE state = 'NO_MATCH') AS no_match FROM ({_R})")
def a4(spark, d):
    return decide.summary(_results(spark, d))


@_query("d13_csv_rows", f"SELECT p_name || ' ' || id AS text, CASE WHEN state IN ('EXACT_MATCH', 'HIGH_CONFIDENCE') THEN p_name ELSE '' END AS matched_text, t::varchar AS percentage, CASE state WHEN 'NO_MATCH' THEN 'LOW' WHEN 'REVIEW_REQUIRED' THEN 'REVIEW' ELSE 'HIGH' END AS confidence, CASE WHEN state = 'NO_MATCH' THEN '' ELSE 'K' || id || '-1 (' || t || '); K' || id || '-2 (' || CASE WHEN tie THEN rtrim(rtrim(printf('%.2f', t - 0.5), '0'), '.') ELSE (t - 3)::varchar END || ')' END AS top FROM ({_R}) JOIN part ON p_partkey = id")
def d13(spark, d):
    rows = export.csv_rows(_results(spark, d))
    return rows.select(c("Requested Description").alias("text"), c("Matched Description").alias("matched_text"), c("Matching Percentage").alias("percentage"), c("Confidence").alias("confidence"), c("Top Candidates").alias("top"))

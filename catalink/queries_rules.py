"""Queries of rules of ingest, opinions, picks and exports; their SQL states the rules on its own, over values made from every part so that each branch occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .functions import units as U
from .operators import adjudicate, decide, explain, export, ingest
from .plans.stages import kept_together, spread
from .queries import _FOUR, _four, _query
from .queries_results import _R, _cells, _part, _results
from .sources import adapters as A

c = F.col


# --- ingest
@_query("p11_cells", "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN p_size::varchar WHEN 1 THEN p_size || '.5' WHEN 2 THEN '2024-02-' || lpad((p_partkey % 28 + 1)::varchar, 2, '0') || ' 10:30:00' WHEN 3 THEN '2024-02-' || lpad((p_partkey % 28 + 1)::varchar, 2, '0') WHEN 4 THEN '' WHEN 5 THEN '2024-03-01 00:00:07' ELSE p_name END AS text FROM part")
def p11(spark, d):
    day = "lpad(cast(p_partkey % 28 + 1 AS string), 2, '0')"
    value = f"CASE p_partkey % 7 WHEN 0 THEN p_size || '.0' WHEN 1 THEN p_size || '.5' WHEN 2 THEN '2024-02-' || {day} || ' 10:30:00' WHEN 3 THEN '2024-02-' || {day} || ' 00:00:00' WHEN 4 THEN ' ' WHEN 5 THEN '2024-03-01 00:00:07' ELSE ' ' || p_name END AS v"
    kind = "CASE WHEN p_partkey % 7 <= 1 THEN 'number' WHEN p_partkey % 7 IN (2, 3, 5) THEN 'date' ELSE 'text' END AS k"
    return _part(spark, d, value, kind).select("id", ingest.cell_text(c("v"), c("k")).alias("text"))


def _heads(spark, d):
    """Five kinds of header rows: aliases; one column that remains; a title of one cell; a name twice; none."""
    rows = "array(named_struct('row', 1, 'col', 1, 'value', CASE WHEN k = 2 THEN 'QUOTE' WHEN k = 4 THEN 'a' ELSE CASE k WHEN 0 THEN 'Catalog #' WHEN 1 THEN 'Qty.' ELSE 'Product' END END), named_struct('row', 1, 'col', 2, 'value', CASE k WHEN 0 THEN 'Product_Description' WHEN 1 THEN 'MPN' WHEN 3 THEN 'Product' WHEN 4 THEN 'b' ELSE ' ' END), named_struct('row', 1, 'col', 3, 'value', CASE k WHEN 0 THEN 'Order QTY' WHEN 1 THEN 'Stuff' WHEN 3 THEN 'UNITS' WHEN 4 THEN 'c' END))"
    return A.read(spark, d, "part").selectExpr("concat('f', p_partkey) AS file", "cast(p_partkey % 5 AS int) AS k").selectExpr("file", f"explode({rows}) AS x").select("file", "x.*", F.lit("text").alias("kind"))


@_query("p6_header_row", """SELECT 'f' || p_partkey AS file, 1 AS header_row, unnest(CASE p_partkey % 5 WHEN 0 THEN ['description', 'quantity', 'part_number'] WHEN 1 THEN ['description', 'quantity', 'part_number'] WHEN 2 THEN ['description'] WHEN 3 THEN ['description', 'quantity'] ELSE [] END) AS field,
    unnest(CASE p_partkey % 5 WHEN 0 THEN [2, 3, 1] WHEN 1 THEN [3, 1, 2] WHEN 2 THEN [1] WHEN 3 THEN [2, 3] ELSE [] END) AS col FROM part""")
def p6(spark, d):
    return ingest.header_fields(_heads(spark, d))


@_query("p9_header_fields", "SELECT 'f' || p_partkey % 5 AS file, unnest(['description', 'quantity', 'part_number']) AS field, unnest([2, 3, 1]) AS col, count(*) AS parts FROM part GROUP BY 1, 2, 3")
def p9(spark, d):
    parts = A.read(spark, d, "part").selectExpr("concat('f', p_partkey % 5) AS file").groupBy("file").agg(F.count(F.lit(1)).alias("parts"))
    return ingest.header_fields(_cells(spark, d)).join(parts, "file").select("file", "field", "col", "parts")


@_query("p7_headerless", "SELECT 'f' || p_partkey AS file, 2 AS text_col, 4 AS number_col FROM part WHERE p_partkey % 6 IN (0, 5)")
def p7(spark, d):
    """Twenty rows of a text and a number; then such with one row that differs: swapped, with a third cell, of two texts, moved; last, after row 20."""
    odd = "r = CASE k WHEN 5 THEN 25 ELSE 7 END"
    cells = f"""array(named_struct('col', CASE WHEN k = 1 AND {odd} THEN 4 WHEN k = 4 AND {odd} THEN 3 ELSE 2 END, 'value', p_name, 'kind', 'text'), named_struct('col', CASE WHEN k = 1 AND {odd} THEN 2 ELSE 4 END, 'value', cast(p_size AS string), 'kind', CASE WHEN k = 3 AND {odd} THEN 'text' ELSE 'number' END),
        named_struct('col', 5, 'value', CASE WHEN k IN (2, 5) AND {odd} THEN 'more' ELSE ' ' END, 'kind', 'text'))"""
    files = kept_together(A.read(spark, d, "part").selectExpr("concat('f', p_partkey) AS file", "p_partkey % 6 AS k", "p_name", "p_size"), "file")
    rows = files.selectExpr("*", "explode(sequence(1, 25)) AS r")
    return ingest.headerless_files(rows.selectExpr("file", "r AS row", f"explode({cells}) AS x").select("file", "row", "x.*"))


@_query("p14_page_lines", """SELECT 'f' || p_partkey AS file, 'Page ' || page AS source_sheet, n AS source_row, text AS requested_description, q::double AS quantity FROM (
    SELECT p_partkey, unnest([1, 1, 1, 1, 2]) AS page, unnest([3, 4, 5, 6, 8]) AS n, unnest([p_name, '12.50', 'quote 7 ' || p_name, p_name || ' 3/4', p_name || ' NOTES']) AS text, unnest([1000 + p_size, NULL, 7, NULL, 5]) AS q FROM part)""")
def p14(spark, d):
    texts = [(1, 1, "'LIST OF GOODS'"), (1, 2, "'Description Qty Notes'"), (1, 3, "concat(p_name, '  1,0', lpad(cast(p_size AS string), 2, '0'))"), (1, 4, "'12.50'"), (1, 5, "concat('quote 7 ', p_name)"), (1, 6, "concat(p_name, ' 3/4')"), (1, 7, "' '"),
             (2, 1, "'LIST OF GOODS '"), (2, 2, "concat(p_name, ' NOTES 5')"), (2, 3, "'Total 5'"), (2, 4, "'17'"), (2, 5, "'x'")]
    lines = ", ".join(f"named_struct('page', {p}, 'line_no', {n}, 'text', {t})" for p, n, t in texts)
    files = kept_together(A.read(spark, d, "part").selectExpr("concat('f', p_partkey) AS file", "p_name", "p_size"), "file")
    rows = files.selectExpr("file", f"explode(array({lines})) AS x").select("file", "x.*")
    return ingest.page_lines(rows).select("file", "source_sheet", "source_row", "requested_description", "quantity")


@_query("p15_candidate_lines", "SELECT 'f' || p_partkey AS file, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ITEM' ELSE '' END AS text FROM part WHERE p_partkey % 7 NOT IN (1, 2, 3, 4)")
def p15(spark, d):
    """Words that are no header words stay; headers, totals, digits and single letters go."""
    text = "CASE p_partkey % 7 WHEN 1 THEN 'Qty UNIT price' WHEN 2 THEN 'Grand  total: 5' WHEN 3 THEN cast(p_partkey AS string) WHEN 4 THEN 'x' ELSE concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' ITEM' ELSE '' END) END AS text"
    rows = A.read(spark, d, "part").selectExpr("concat('f', p_partkey) AS file", "1 AS page", "1 AS line_no", text)
    return ingest.page_lines(rows).select("file", F.col("requested_description").alias("text"))


@_query("p16_warnings", """SELECT 'f' || p_partkey AS file, CASE p_partkey % 3 WHEN 0 THEN 'No header row was found in "f' || p_partkey || '" -- Description and Quantity columns were inferred from the data.' ELSE '"f' || p_partkey || '" repeated a column header (e.g. "QTY") mid-file -- those rows were skipped as section labels, not line items.' END AS warning FROM part WHERE p_partkey % 3 < 2
    UNION ALL SELECT 'g' || p_partkey, 'Could not detect a clear quantity column in "g' || p_partkey || '" -- quantities were inferred from line text where possible.' FROM part WHERE p_partkey % 2 = 0""")
def p16w(spark, d):
    cells = "array(named_struct('row', 1, 'col', 1, 'value', CASE k WHEN 0 THEN 'bolt' ELSE 'Name' END, 'kind', 'text'), named_struct('row', 1, 'col', 2, 'value', CASE k WHEN 0 THEN '5' ELSE 'Qty' END, 'kind', CASE k WHEN 0 THEN 'number' ELSE 'text' END), named_struct('row', 2, 'col', 1, 'value', 'nut', 'kind', 'text'), named_struct('row', 2, 'col', 2, 'value', CASE k WHEN 1 THEN 'QTY' ELSE '6' END, 'kind', CASE k WHEN 1 THEN 'text' ELSE 'number' END))"
    rows = A.read(spark, d, "part").selectExpr("concat('f', p_partkey) AS file", "p_partkey % 3 AS k").selectExpr("file", f"explode({cells}) AS x").select("file", "x.*")
    pages = A.read(spark, d, "part").selectExpr("concat('g', p_partkey) AS file", "1 AS page", "1 AS line_no", "concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' 5' END) AS text")
    return ingest.cell_warnings(rows).unionByName(ingest.page_warnings(ingest.page_lines(pages)))


# --- texts and measures
@_query("f7_codes", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN (1000 + p_size)::varchar WHEN 1 THEN p_size::varchar WHEN 2 THEN 'aB-' || p_size || ' x' WHEN 3 THEN p_size || '.50' ELSE '' END AS code FROM part")
def f7(spark, d):
    value = "CASE p_partkey % 5 WHEN 0 THEN ' 1,0' || lpad(cast(p_size AS string), 2, '0') WHEN 1 THEN p_size || '.00' WHEN 2 THEN 'aB-' || p_size || '   x ' WHEN 3 THEN p_size || '.50' END AS v"
    return _part(spark, d, value).select("id", T.code_as_given(c("v")).alias("code"))


@_query("f13_unit_words", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size || ' IN pipe 120 V AC end' WHEN 1 THEN '0.75 IN x 10 FT' WHEN 2 THEN 'at ' || p_size * 1000 || ' V rated' ELSE p_name || ' 40/80' END AS text FROM part")
def f13(spark, d):
    value = "CASE p_partkey % 4 WHEN 0 THEN p_size || ' inch pipe 120VAC end' WHEN 1 THEN '3/4\" x 10 feet' WHEN 2 THEN 'at ' || p_size || ' KV rated' ELSE p_name || ' 40/80' END AS v"
    return _part(spark, d, value).select("id", U.unit_words(c("v")).alias("text"))


@_query("f14_attached", "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN p_size || '|V|AC' WHEN 1 THEN p_size || '|V|DC' WHEN 2 THEN p_size || '|AMP' WHEN 3 THEN p_size || '|KV' WHEN 4 THEN 'V|AC' WHEN 5 THEN 'V|DC' ELSE 'X' || p_size || 'V' END AS parts FROM part")
def f14(spark, d):
    value = "CASE p_partkey % 7 WHEN 0 THEN p_size || 'VAC' WHEN 1 THEN p_size || 'VDC' WHEN 2 THEN p_size || 'A' WHEN 3 THEN p_size || 'KV' WHEN 4 THEN 'VAC' WHEN 5 THEN 'VDC' ELSE 'X' || p_size || 'V' END AS v"
    return _part(spark, d, value).select("id", F.array_join(T.attached_unit(c("v")), "|").alias("parts"))


@_query("f15_raw_tokens", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '36|24|' || p_size || '|FT' WHEN 1 THEN '3/4|EMT|A|B' WHEN 2 THEN upper(split_part(p_name, ' ', 1)) || '|AND|120|V|30|AMP' ELSE '1.5|X|' || p_size END AS tokens FROM part")
def f15(spark, d):
    value = "CASE p_partkey % 4 WHEN 0 THEN '36X24x' || p_size || 'ft' WHEN 1 THEN '3/4 EMT a/b' WHEN 2 THEN split_part(p_name, ' ', 1) || ' & 120V 30A' ELSE '1.5 x ' || p_size END AS v"
    return _part(spark, d, value).select("id", F.array_join(T.raw_tokens(c("v")), "|").alias("tokens"))


@_query("f16_tokens", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'CONN|V|120' WHEN 1 THEN 'CBL|EXT|' || p_size WHEN 2 THEN 'STRUT|W|GALV|FITTING' ELSE upper(split_part(p_name, ' ', 1)) END AS tokens FROM part")
def f16(spark, d):
    value = "CASE p_partkey % 4 WHEN 0 THEN 'connectors for volts of 120' WHEN 1 THEN 'the Cables, extension x ' || p_size WHEN 2 THEN 'unistrut wire galvanised joiner' ELSE 'a ' || split_part(p_name, ' ', 1) END AS v"
    return _part(spark, d, value).select("id", F.array_join(T.tokens(c("v")), "|").alias("tokens"))


@_query("f6_canonical", "SELECT p_partkey AS id, 'CONN ' || upper(split_part(p_name, ' ', 1)) || ' 3/4' AS text FROM part")
def f6(spark, d):
    return _part(spark, d, "'Connectors with ' || split_part(p_name, ' ', 1) || ' 3/4' AS v").select("id", T.canonical(c("v")).alias("text"))


@_query("f21_search_steps", "SELECT p_partkey AS id, 'quote ' || p_size || ' for the ' || p_name || ' cables' AS original_input, p_size AS extracted_quantity, 'for the ' || p_name || ' cables' AS after_quantity_removal, p_name || ' cables' AS after_noise_removal, p_name || ' cbl' AS after_terminology_normalization, replace(p_name, ' ', '|') || '|cbl' AS tokens FROM part")
def f21(spark, d):
    x = T.search_steps(F.concat(F.lit(" quote "), c("p_size"), F.lit(" for the  "), c("p_name"), F.lit(" cables")))
    rows = spread(A.read(spark, d, "part")).select(c("p_partkey").alias("id"), x.alias("x")).select("id", "x.*")
    return rows.withColumn("tokens", F.array_join("tokens", "|"))


@_query("f37_abbreviations", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'volts → V; ' || p_size || ' volts → ' || p_size || 'V; extension → EXT' WHEN 1 THEN 'connectors → CONN' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN 'volts → V' ELSE 'v → V; 120 v → 120V' END AS terms FROM part""")
def f37(spark, d):
    asked = "CASE p_partkey % 6 WHEN 0 THEN p_size || ' volts extension extension' WHEN 1 THEN 'connectors conn' WHEN 2 THEN 'cables' WHEN 3 THEN p_name WHEN 4 THEN 'volts' ELSE '120V' END AS a"
    row = "CASE p_partkey % 6 WHEN 0 THEN p_size || ' ext' WHEN 1 THEN 'CONN' WHEN 2 THEN p_name WHEN 3 THEN p_name WHEN 4 THEN '5 V' ELSE '120 VAC' END AS b"
    return _part(spark, d, asked, row).select("id", F.array_join(T.abbreviations(T.raw_tokens(c("a")), T.tokens(c("b"))), "; ").alias("terms"))


@_query("n7_unit_lines", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Voltage: 120V AC ↔ 120 volts — Match' WHEN 1 THEN 'Voltage mismatch: requested 4.5KV, catalog 120V, 240V' WHEN 2 THEN 'Dimension mismatch: requested ' || p_size || ' in, catalog 3/4"' WHEN 3 THEN 'Dimension: 3/4" ↔ 0.75 in — Match|Amperage mismatch: requested 30A, catalog 20A' ELSE '' END AS lines FROM part""")
def n7(spark, d):
    asked = "CASE p_partkey % 5 WHEN 0 THEN 'at 120 volts' WHEN 1 THEN '4.5 kV' WHEN 2 THEN p_size || ' in' WHEN 3 THEN '0.75 in 30 A' ELSE p_name END AS a"
    row = "CASE p_partkey % 5 WHEN 0 THEN '120VAC x' WHEN 1 THEN '120 V or 240 V or 120 volt' WHEN 4 THEN '120 V' ELSE '3/4\" 20 amps' END AS b"
    rows = _part(spark, d, asked, row)
    volts = U.voltage_status(U.voltages(c("a")), U.voltages(c("b")))
    dims = U.dimension_status(U.dimensions(c("a")), U.dimensions(c("b")))
    amps = U.overlap_status(U.amperages(c("a")), U.amperages(c("b")))
    return rows.select("id", F.array_join(U.unit_lines(U.said(c("a")), U.said(c("b")), volts, dims, amps), "|").alias("lines"))


@_query("n8_decimals", "SELECT p_partkey AS id, rtrim(rtrim(printf('%.4f', p_size / 8.0::double), '0'), '.') AS text FROM part")
def n8(spark, d):
    return _part(spark, d, "p_size / 8D AS v").select("id", U.decimal_text(c("v")).alias("text"))


@_query("n6_dimension_state", "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'match' WHEN 1 THEN 'conflict' WHEN 2 THEN 'conflict' WHEN 3 THEN 'match' WHEN 4 THEN 'none' ELSE 'conflict' END AS state FROM part")
def n6(spark, d):
    """Two sizes on both sides must be equal in order; one side with a single size needs it among the other's."""
    asked = "CASE p_partkey % 6 WHEN 0 THEN '2 in 3 in' WHEN 1 THEN '2 in 3 in' WHEN 2 THEN '2 in 3 in' WHEN 3 THEN '3 in' WHEN 4 THEN p_name ELSE '2 ft' END AS a"
    row = "CASE p_partkey % 6 WHEN 0 THEN '2\" 3\"' WHEN 1 THEN '3 in 2 in' WHEN 2 THEN '2 in 3 in 4 in' WHEN 3 THEN '2 in 3 in 4 in' ELSE '2 in' END AS b"
    return _part(spark, d, asked, row).select("id", U.dimension_status(U.dimensions(c("a")), U.dimensions(c("b"))).alias("state"))


# --- reasons
@_query("d8_candidate_reasons", """SELECT id, concat_ws('|', CASE WHEN kind = 'exact' THEN 'Exact Productcode Match|Matching tokens: AB → AB' WHEN kind = 'partial' AND e > 0 THEN 'Partial Productcode / Name Match|Matching tokens: AB → AB12' END,
    CASE WHEN id % 7 = 0 AND e < 40 THEN 'Normalized Description Match|Normalized terms: volts → V' END, CASE WHEN greatest(e, t, f, a) > 0 THEN 'Strongest text evidence from ' || CASE greatest(e, t, f, a) WHEN e THEN 'Productcode' WHEN t THEN 'name' WHEN f THEN 'description' ELSE 'description2' END END,
    'Productcode match: ' || e::int || '; Name match: ' || t::int || '; Description match: ' || f::int || '; Description2 match: ' || a::int,
    CASE WHEN e >= 100 THEN CASE WHEN id % 2 = 0 THEN 'Exact normalized description match' ELSE 'Exact match after synonym/abbreviation normalization|Description differs only by abbreviation' END END,
    CASE WHEN id % 5 = 0 THEN 'Multiple products have the same description' END, CASE WHEN id % 3 = 0 THEN 'Voltage matched: 120' END, CASE WHEN id % 11 = 0 THEN 'Amperage: 20A ↔ 20 A — Match' END, CASE WHEN id % 3 = 0 THEN 'Product type matched: SWITCH MODULE|CABLE attribute matched|Size matched: 1.000000IN' END,
    CASE WHEN id % 3 = 0 AND t > 0 AND e < 100 THEN 'Shared tokens: CABLE, ZINC' END, CASE WHEN e < 100 AND f > 0 THEN 'Character similarity ' || f::int || '.0%' END) AS reasons
    FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'none' END AS kind FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 100.0 ELSE e END AS e, t, f, a FROM """ + _FOUR + "))")
def d8(spark, d):
    rows = _four(spark, d).selectExpr("*", "CASE id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'none' END AS kind").withColumn("e", F.when(c("kind") == "exact", 100.0).otherwise(c("e")))
    tags = "array('voltage:120', 'token:ZINC', 'token:CABLE', 'phrase:SWITCH MODULE', 'size:1.000000IN')"
    rows = rows.selectExpr("*", f"{tags} AS asked", f"CASE WHEN id % 3 = 0 THEN {tags} ELSE array('token:X', 'voltage:240') END AS row", "array('AB') AS words", "CASE WHEN kind = 'exact' THEN 'AB' ELSE 'AB12' END AS code", "array(CASE WHEN kind = 'exact' THEN 'AB' ELSE 'AB12' END, 'Q') AS code_words")
    scores = F.struct(c("e").alias("productcode"), c("t").alias("name"), c("f").alias("description"), c("a").alias("description2"))
    told = explain.matching_tokens(c("words"), c("words"), c("kind"), F.when(c("kind") == "exact", "AB").otherwise("ZZAB"), c("code"), c("code_words"))
    terms = F.when(c("id") % 7 == 0, F.array(F.lit("volts → V"))).otherwise(F.array().cast("array<string>"))
    lines = F.when(c("id") % 11 == 0, F.array(F.lit("Amperage: 20A ↔ 20 A — Match")))
    reasons = explain.candidate_reasons(c("asked"), c("row"), scores, c("e"), c("t"), c("f"), c("id") % 5 == 0, c("id") % 2 == 0, c("kind"), told, terms, lines, explain.strongest(scores))
    return rows.select("id", F.array_join(reasons, "|").alias("reasons"))


@_query("d11_label", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Automatic — Exact Productcode' WHEN 1 THEN 'Automatic — Partial Productcode' WHEN 2 THEN 'Automatic — Description Match' WHEN 3 THEN 'Automatic' ELSE 'Automatic — Exact Productcode' END AS label FROM part")
def d11l(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("normalized_exact", "partial", "none", "none", "partial"))), (c("id") % 5 + 1).cast("int"))
    return _part(spark, d).select("id", decide.automatic_label(kind, c("id") % 5 == 4, c("id") % 5 == 2).alias("label"))


# --- opinions
@_query("i1_needed", f"SELECT id AS line_id FROM ({_R}) WHERE state <> 'NO_MATCH' AND NOT (state = 'EXACT_MATCH' AND id % 8 = 0)")
def i1(spark, d):
    return adjudicate.needed(_results(spark, d)).select("line_id")


@_query("i2_requests", f"""SELECT id AS line_id, '{{"requested_description":"' || p_name || ' ' || id || '"' || CASE WHEN id % 3 = 0 THEN ',"quantity":' || p_size || '.0' ELSE '' END || ',"candidates":[{{"official_part_number":"K' || id || '-1","description":"' || p_name || '","salsify_id":"id' || id || '-1","deterministic_score":' || t || '.0,"match_reasons":["why"]}}]'
    || CASE WHEN id % 2 = 0 THEN ',"catalog_terminology_note":"wide"' ELSE '' END || '}}' AS request FROM ({_R}) JOIN part ON p_partkey = id WHERE state <> 'NO_MATCH' AND NOT (state = 'EXACT_MATCH' AND id % 8 = 0)""")
def i2(spark, d):
    return adjudicate.requests(_results(spark, d), F.when(c("line_id") % 2 == 0, "wide"), 1)


@_query("i3_heuristic", f"""SELECT id AS line_id, CASE WHEN one + two > 1 THEN 'REVIEW_REQUIRED' WHEN NOT tie AND t >= 90 THEN 'CONFIDENT_MATCH' WHEN t < 50 THEN 'NO_MATCH' ELSE 'REVIEW_REQUIRED' END AS decision, CASE WHEN one + two > 1 THEN 40.0 WHEN NOT tie AND t >= 90 THEN 95.0 WHEN t < 50 THEN 10.0 ELSE 55.0 END::double AS confidence, CASE WHEN one + two <= 1 AND NOT tie AND t >= 90 THEN 'K' || id || '-1' END AS part
    FROM (SELECT *, (id % 3 = 0 OR t = 100)::int AS one, (tie AND (id % 6 = 0 OR t = 100))::int AS two FROM ({_R}) WHERE state <> 'NO_MATCH') UNION ALL SELECT id, 'NO_MATCH', 0.0, NULL FROM ({_R}) WHERE state = 'NO_MATCH'""")
def i3(spark, d):
    x = _results(spark, d).select("line_id", adjudicate.heuristic(c("candidates"), F.lit("SAME")).alias("x"))
    return x.select("line_id", "x.decision", "x.confidence", "x.part")


@_query("i4_policy", f"""SELECT id, CASE WHEN id % 11 = 0 OR (id % 3 = 1 AND id % 5 = 0) THEN 'NO_MATCH' WHEN id % 5 = 0 OR id % 7 = 0 OR id % 13 = 0 OR t < 50 THEN 'REVIEW_REQUIRED' WHEN id % 3 = 0 AND t >= 90 THEN 'CONFIDENT_MATCH' ELSE 'REVIEW_REQUIRED' END AS status FROM {_FOUR}""")
def i4(spark, d):
    decision = F.when(c("id") % 3 == 0, "CONFIDENT_MATCH").when(c("id") % 3 == 1, "NO_MATCH").otherwise("REVIEW_REQUIRED")
    return _four(spark, d).select("id", adjudicate.policy(decision, F.when(c("id") % 5 != 0, "K"), c("id") % 7 != 0, F.when(c("id") % 13 != 0, c("t")), c("id") % 11 != 0).alias("status"))


@_query("i5_combined", f"SELECT id, CASE WHEN id % 4 = 0 THEN t WHEN id % 3 = 0 THEN least(t, f) ELSE f END AS confidence FROM {_FOUR}")
def i5(spark, d):
    status = F.when(c("id") % 3 == 0, "CONFIDENT_MATCH").when(c("id") % 3 == 1, "NO_MATCH").otherwise("REVIEW_REQUIRED")
    return _four(spark, d).select("id", adjudicate.combined(c("t"), F.when(c("id") % 4 != 0, c("f")), status).alias("confidence"))


@_query("i6_parsed", """SELECT p_partkey AS line_id, CASE p_partkey % 7 WHEN 0 THEN 'CONFIDENT_MATCH' WHEN 4 THEN 'NO_MATCH' WHEN 5 THEN 'CONFIDENT_MATCH' ELSE 'REVIEW_REQUIRED' END AS decision, CASE WHEN p_partkey % 7 IN (0, 5) THEN 'K' || p_partkey END AS part, CASE WHEN p_partkey % 7 IN (0, 5) THEN (p_partkey % 101)::double END AS confidence,
    CASE p_partkey % 7 WHEN 0 THEN 'size; volts: 120, 240; kind: x' WHEN 4 THEN '' WHEN 5 THEN 'size: ok; volts: 120, 240' END AS matched, p_partkey % 7 IN (0, 4, 5) AS valid FROM part""")
def i6(spark, d):
    start = "'{\"decision\": \"CONFIDENT_MATCH\", \"selected_part_number\": \"K', p_partkey, '\", \"confidence_percentage\": ', p_partkey % 101, ', \"reasoning_summary\": \"s\", \"matched_attributes\": '"
    body = f"""CASE p_partkey % 7 WHEN 0 THEN concat({start}, '["size", {{"volts": ["120", "240"], "kind": "x"}}]}}') WHEN 1 THEN 'no json' WHEN 2 THEN '{{"decision": "PERHAPS", "reasoning_summary": "s"}}' WHEN 3 THEN '{{"decision": "CONFIDENT_MATCH", "confidence_percentage": 500, "reasoning_summary": "s"}}'
        WHEN 4 THEN '{{"decision": "NO_MATCH", "selected_part_number": " ", "confidence_percentage": null, "reasoning_summary": "s"}}' WHEN 5 THEN concat({start}, '{{"size": "ok", "volts": ["120", "240"]}}}}') ELSE '{{"decision": "CONFIDENT_MATCH", "confidence_percentage": 95}}' END AS body"""
    found = adjudicate.parsed_opinions(A.read(spark, d, "part").selectExpr("p_partkey AS line_id", body))
    return found.select("line_id", "decision", "part", "confidence", F.array_join("matched", "; ").alias("matched"), "valid")


@_query("i8_adjudicated", f"""SELECT line_id, decision, part, rejected, rejected IS NOT NULL AS validation_rejected, CASE WHEN rejected IS NOT NULL THEN 'REVIEW_REQUIRED' ELSE decision END AS status, CASE WHEN rejected IS NULL AND decision = 'CONFIDENT_MATCH' THEN least(t, confidence) ELSE confidence END::double AS confidence, CASE WHEN rejected IS NULL THEN part END AS matched_part
    FROM (SELECT *, CASE WHEN part IS NOT NULL AND line_id % 7 = 0 THEN 'AI returned a family/parent identifier' WHEN part IS NOT NULL AND line_id % 3 = 0 THEN 'AI selected a part number that is not in the approved product catalog' END AS rejected
    FROM (SELECT id AS line_id, t, CASE WHEN tie AND t = 100 THEN 'REVIEW_REQUIRED' WHEN NOT tie AND t >= 90 THEN 'CONFIDENT_MATCH' WHEN t < 50 THEN 'NO_MATCH' ELSE 'REVIEW_REQUIRED' END AS decision, CASE WHEN tie AND t = 100 THEN 40.0 WHEN NOT tie AND t >= 90 THEN 95.0 WHEN t < 50 THEN 10.0 ELSE 55.0 END AS confidence, CASE WHEN NOT tie AND t >= 90 THEN 'K' || id || '-1' END AS part
    FROM ({_R}) WHERE state <> 'NO_MATCH' AND NOT (state = 'EXACT_MATCH' AND id % 8 = 0)))""")
def i8(spark, d):
    part = A.read(spark, d, "part")
    code = "concat('K', p_partkey, '-1') AS code"
    done = adjudicate.adjudicated(_results(spark, d), part.where("p_partkey % 3 <> 0").selectExpr(code), part.where("p_partkey % 7 = 0").selectExpr(code))
    return done.select("line_id", "decision", "part", "rejected", "validation_rejected", "status", "confidence", "matched_part")


@_query("i10_given_opinions", f"""SELECT id AS line_id, CASE WHEN id % 5 = 0 THEN 'CONFIDENT_MATCH' ELSE 'REVIEW_REQUIRED' END AS status, CASE WHEN id % 5 = 0 THEN least(95.0, CASE WHEN tie THEN t - 0.5 ELSE t - 3 END) WHEN id % 5 = 1 THEN 30.0 WHEN id % 5 = 2 THEN 95.0 ELSE t END::double AS confidence, id % 5 >= 2 AS validation_rejected,
    CASE id % 5 WHEN 0 THEN 'said' WHEN 1 THEN 'AI confidence is below the review threshold.' WHEN 2 THEN 'AI selected a part number that was not in the candidate list' ELSE 'Malformed AI response' END AS summary, CASE WHEN id % 5 = 0 THEN 'ORD' || id END AS matched_orderable FROM ({_R}) WHERE state <> 'NO_MATCH' AND NOT (state = 'EXACT_MATCH' AND id % 8 = 0)""")
def i10(spark, d):
    """Opinions given from outside: a listed part, a doubtful one, a part not listed, a malformed one, none."""
    results = _results(spark, d)
    told = results.where("line_id % 5 < 4").selectExpr("line_id", "'CONFIDENT_MATCH' AS decision", "concat('K', line_id, CASE WHEN line_id % 5 = 2 THEN '-9' ELSE '-2' END) AS part", "CASE WHEN line_id % 5 = 1 THEN 30D ELSE 95D END AS confidence", "'said' AS summary", "line_id % 5 < 3 AS valid")
    codes = A.read(spark, d, "part").selectExpr("explode(array(concat('K', p_partkey, '-2'), concat('K', p_partkey, '-9'))) AS code")
    done = adjudicate.adjudicated(results, codes, codes.limit(0), told)
    return done.select("line_id", "status", "confidence", "validation_rejected", "summary", "matched_orderable")


@_query("i11_prompt", f"""SELECT id AS line_id, md5('{adjudicate.PROMPT[0].replace("{maker} ", "").replace("'", "''")}{adjudicate.PROMPT[1]}' || p_name || ' ' || id || '{adjudicate.PROMPT[2]}' || CASE WHEN id % 3 = 0 THEN p_size::varchar ELSE 'null' END || '{adjudicate.PROMPT[3]}' || CASE WHEN id % 2 = 0 THEN 'catalog_terminology_note: wide' || chr(10) ELSE '' END || '{adjudicate.PROMPT[5]}'
    || '[{{"official_part_number":"K' || id || '-1","description":"' || p_name || '","salsify_id":"id' || id || '-1","deterministic_score":' || t || '.0,"match_reasons":["why"]}}]' || '{adjudicate.PROMPT[6]}') AS digest FROM ({_R}) JOIN part ON p_partkey = id WHERE state <> 'NO_MATCH' AND NOT (state = 'EXACT_MATCH' AND id % 8 = 0)""")
def i11(spark, d):
    asked = adjudicate.requests(_results(spark, d), F.when(c("line_id") % 2 == 0, "wide"), 1)
    return asked.select("line_id", F.md5(adjudicate.prompt(c("request"))).alias("digest"))


# --- picks, runs and files
@_query("j14_selected", f"""SELECT id AS line_id, CASE WHEN picked THEN 'HIGH_CONFIDENCE' ELSE state END AS status, CASE WHEN picked THEN 'K' || id || '-2' WHEN state IN ('EXACT_MATCH', 'HIGH_CONFIDENCE') THEN 'K' || id || '-1' END AS matched_part, CASE WHEN picked OR id % 8 = 0 THEN 'ORD' || id END AS matched_orderable, CASE WHEN picked THEN p_name || ' two' END AS matched_description,
    CASE WHEN picked THEN 'USER_SELECTED' WHEN state IN ('EXACT_MATCH', 'HIGH_CONFIDENCE') THEN 'AUTOMATIC' END AS selection_type, CASE WHEN picked THEN 'User Selected' END AS match_type_label, CASE WHEN picked THEN 'User selected Productcode K' || id || '-2|first|second' ELSE 'first|second' END AS reasons, t::double AS original_confidence, picked OR id % 8 = 0 AS part_number_match
    FROM (SELECT *, state = 'REVIEW_REQUIRED' AND id % 3 = 0 AS picked FROM ({_R})) JOIN part ON p_partkey = id""")
def j14(spark, d):
    picks = A.read(spark, d, "part").selectExpr("p_partkey AS line_id", "explode(CASE WHEN p_partkey % 3 = 0 THEN array(concat(' K', p_partkey, '-2'), concat('K', p_partkey, '-9')) ELSE array(concat('K', p_partkey, '-9')) END) AS product_code")
    done = decide.selected(_results(spark, d), picks).withColumn("reasons", F.array_join("reasons", "|"))
    return done.select("line_id", "status", "matched_part", "matched_orderable", "matched_description", "selection_type", "match_type_label", "reasons", "original_confidence", "part_number_match")


@_query("j14_refused", f"""SELECT id AS line_id, 'K' || id || CASE WHEN id % 3 = 0 THEN '-2' ELSE '-9' END AS product_code, CASE WHEN state <> 'REVIEW_REQUIRED' THEN 'Only REVIEW_REQUIRED lines can be selected.' ELSE 'Productcode is not in the candidate list.' END AS reason FROM ({_R}) WHERE state <> 'REVIEW_REQUIRED' OR id % 3 <> 0""")
def j14r(spark, d):
    picks = A.read(spark, d, "part").selectExpr("p_partkey AS line_id", "concat('K', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '-2' ELSE '-9' END) AS product_code")
    return decide.refused_picks(_results(spark, d), picks)


@_query("j15_differences", f"""WITH b AS (SELECT p_name AS text, arg_max(CASE WHEN id % 3 = 1 THEN 'NO_MATCH' ELSE state END, id) AS old_status, arg_max(CASE WHEN state IN ('EXACT_MATCH', 'HIGH_CONFIDENCE') THEN 'K' || id || '-1' ELSE '' END, id) AS old_part FROM ({_R}) JOIN part ON p_partkey = id WHERE id % 2 = 0 GROUP BY 1)
    SELECT id AS line_id, CASE WHEN old_status IS NULL THEN 'NEW' WHEN state = old_status AND CASE WHEN state IN ('EXACT_MATCH', 'HIGH_CONFIDENCE') THEN 'K' || id || '-1' ELSE '' END = old_part THEN 'SAME' ELSE 'CHANGED' END AS change FROM ({_R}) JOIN part ON p_partkey = id LEFT JOIN b ON b.text = p_name""")
def j15(spark, d):
    """Texts repeat: of the earlier run the last line of a text counts."""
    names = A.read(spark, d, "part").selectExpr("p_partkey AS line_id", "p_name")
    rows = _results(spark, d).drop("requested_description").join(names, "line_id").withColumnRenamed("p_name", "requested_description")
    before = rows.where("line_id % 2 = 0").withColumn("status", F.when(c("line_id") % 3 == 1, "NO_MATCH").otherwise(c("status")))
    return decide.differences(before, rows).select("line_id", "change")


@_query("s13_order_rows", f"SELECT CASE WHEN id % 8 = 0 THEN 'ORD' || id ELSE 'K' || id || '-1' END AS \"Part Number\", CASE WHEN id % 3 = 0 THEN p_size::varchar ELSE '' END AS \"Quantity\" FROM ({_R}) JOIN part ON p_partkey = id WHERE state IN ('EXACT_MATCH', 'HIGH_CONFIDENCE') AND id % 12 <> 1")
def s13(spark, d):
    """Lines without a number are left out, and a missing quantity stays blank."""
    rows = _results(spark, d).withColumn("matched_part", F.when(c("line_id") % 12 == 1, "").otherwise(c("matched_part")))
    return export.order_file_rows(rows)


_FULL = "CASE state WHEN 'REVIEW_REQUIRED' THEN 'Validation Required' ELSE state END AS \"Status\", CASE WHEN state <> 'NO_MATCH' THEN 'K' || id || '-1' ELSE '' END AS \"1st Top Product\", CASE WHEN state <> 'NO_MATCH' THEN 'ORD' || id ELSE '' END AS \"2nd Top Product\", '' AS \"3rd Top Product\", '' AS \"4th Top Product\", '' AS \"5th Top Product\", CASE WHEN state IN ('EXACT_MATCH', 'HIGH_CONFIDENCE') THEN 'K' || id || '-1' ELSE '' END AS \"Matched Part Number\", CASE WHEN id % 8 = 0 THEN 'ORD' || id ELSE '' END AS \"Orderable Part Number\""


@_query("d14_full_rows", f"SELECT id AS line_id, {_FULL} FROM ({_R})")
def d14(spark, d):
    return export.full_rows(_results(spark, d)).drop("requested_description", "quantity")


@_query("k6_top_columns", f"SELECT id AS line_id, CASE WHEN state <> 'NO_MATCH' THEN 'K' || id || '-1' ELSE '' END AS a, CASE WHEN state <> 'NO_MATCH' THEN 'ORD' || id ELSE '' END AS b, CASE WHEN state <> 'NO_MATCH' THEN 'K' || id || '-3' ELSE '' END AS c, CASE WHEN state <> 'NO_MATCH' THEN 'K' || id || '-4' ELSE '' END AS d, CASE WHEN state <> 'NO_MATCH' THEN 'K' || id || '-5' ELSE '' END AS e FROM ({_R})")
def k6(spark, d):
    more = "CASE WHEN size(candidates) > 0 THEN concat(candidates, transform(sequence(3, 6), i -> named_struct('rank', i, 'product_code', concat('K', line_id, '-', i), 'product_id', '', 'score', 1D, 'orderable', '', 'description', '', 'canonical', '', 'reasons', array('why')))) ELSE candidates END"
    rows = export.full_rows(_results(spark, d).withColumn("candidates", F.expr(more)))
    return rows.select("line_id", *(c(n).alias(a) for n, a in zip(export.ADDED[1:6], "abcde", strict=True)))


@_query("s14_full_file", f"SELECT id AS line_id, CASE WHEN id % 3 = 0 THEN p_name ELSE '' END AS \"Name\", CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN p_size::varchar ELSE '' END AS \"Qty\", CASE WHEN id % 3 <> 0 THEN p_name || ' ' || id ELSE '' END AS \"Requested Description\", '' AS \"Quantity\", CASE WHEN id % 3 = 0 THEN 'more' ELSE '' END AS more, {_FULL} FROM ({_R}) JOIN part ON p_partkey = id")
def s14(spark, d):
    """Lines with cells of their own and lines without; a header beyond the width stands in the map."""
    cells = "array(named_struct('header', 'Name', 'text', p_name, 'col', 1), named_struct('header', 'Qty', 'text', CASE WHEN p_partkey % 2 = 0 THEN cast(p_size AS string) END, 'col', 2), named_struct('header', 'Zone', 'text', 'more', 'col', 3))"
    raw = A.read(spark, d, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey AS line_id", f"explode({cells}) AS x").select("line_id", "x.*")
    first = raw.withColumn("line_id", F.when(c("header") == "Zone", c("line_id")).otherwise(c("line_id")))
    out = export.with_input_columns(export.full_rows(_results(spark, d)), first.withColumn("col", F.when(c("header") == "Zone", 9).otherwise(c("col"))), 5)
    names = {"Name", "Qty", "Requested Description", "Quantity", "Zone"}
    assert names <= set(out.columns)
    return out.withColumnRenamed("Zone", "more").drop(export.OTHER_CELLS)


@_query("s15_documents", f"SELECT id AS line_id, to_json({{'line_id': id, 'status': state, 'matched_part': CASE WHEN state IN ('EXACT_MATCH', 'HIGH_CONFIDENCE') THEN 'K' || id || '-1' END, 'percentage': t::double}})::varchar AS json FROM ({_R})")
def s15(spark, d):
    return export.json_rows(_results(spark, d).select("line_id", "status", "matched_part", "percentage"))


@_query("p17_customer_lines", A.cte("lines") + " SELECT line_id, requested_description, 'ACME' AS customer_name FROM lines")
def p17(spark, d):
    return ingest.with_customer(A.lines(spark, d), "ACME").select("line_id", "requested_description", "customer_name")


@_query("a9_distinct_in_order", "SELECT p_partkey AS id, p_name || '|' || p_brand AS kept FROM part WHERE p_name <> p_brand")
def a9(spark, d):
    rows = _part(spark, d, "p_name", "p_brand").where("p_name <> p_brand")
    return rows.select("id", F.array_join(explain._listed(c("p_name"), F.lit(None).cast("string"), c("p_brand"), c("p_name")), "|").alias("kept"))

"""Queries of text rules, scores and decisions whose SQL states the expected value of each branch on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .functions import units as U
from .operators import decide, ingest, retrieve, score
from .plans import match
from .plans.index import catalog_index
from .queries import _query
from .queries_results import _part
from .sources import adapters as A

c = F.col


def _case(values: list[str], column: str = "p_partkey", quote: str = "'") -> str:
    """One value for each remainder of the key, as an expression that Spark and DuckDB read alike."""
    said = lambda v: "NULL" if v is None else quote + str(v).replace("'", "''") + quote
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {said(v)}" for i, v in enumerate(values)) + " END"


def _rule(name: str, inputs: list[str], outputs: list, expression, quote: str = "'") -> None:
    """A query of one rule: of each part the input by its key's remainder, against the stated output."""

    def run(spark, d):
        return _part(spark, d, f"{_case(inputs)} AS t").select("id", expression(c("t")).alias("found"))

    _query(name, f"SELECT p_partkey AS id, {_case(outputs, quote=quote)} AS found FROM part")(run)


_SAID = ["need 5 - foo", "need 7 foo", "please provide 9 x", "provide 4", "quote 3 of", "qty: 6", "8 pcs rod", "11 of rods", "need 120V cable", "need 1/2 pipe", "need 120 V x", "plain", "Quantity=12 z", "need 3 volts"]
_rule("f18_patterns", _SAID, [5, 7, 9, 4, 3, 6, 8, 11, None, None, None, None, 12, None], lambda t: T.quantity(T.fold(t)), "")
_rule("f19_without_quantity", _SAID, ["foo", "foo", "x", "", "of", "", "rod", "rods", "need 120V cable", "need 1/2 pipe", "need 120 V x", "plain", "z", "need 3 volts"], T.without_quantity)
_rule("f23_strut_codes", ["P-1000HG x", "b-2200", "AB-12345X", "B-22", "P-1000 EG", "xP-1000SS"], ["P1000 HG x", "b2200", "AB12345X", "B-22", "P1000 EG", "xP1000 SS"], T.strut_codes)
_rule("f24_all_acronyms", ["electrical  metallic tubing x", "ss conn 2", "COMP CONN", "comp cplg y", "waterfall", "sss conn"], ["EMT x", "SET SCREW CONNECTOR 2", "COMPRESSION CONNECTOR", "COMPRESSION COUPLING y", "DROP OUT", "sss conn"], T.acronyms)
_rule("f22_labels", ["Cable Tray: bend", "Ring: x", "a b c d: x", "12: x", "no label", " PVC :y"], ["CABLE TRAY", "RING", "", "", "", "PVC"], lambda t: F.array_join(T.label_words(t), " "))
_rule("f22_without_label", ["Cable Tray: bend", "Ring: x", "a b c d: x", "12: x", "no label", " PVC :y"], ["bend", "x", "a b c d: x", "12: x", "no label", "y"], T.without_label)
_rule("f26_all_hole_counts", ["1-H strap", "2 h strap", "1H", "2-H x", "12H", "one hole"], ["ONE HOLE strap", "TWO HOLE strap", "ONE HOLE", "TWO HOLE x", "12H", "one hole"], T.hole_count)
_rule("f27_phrases", ["stl ss conn", "conduit clamp", "hanger clamp", "spring nut", "grc hub", "flex conn", "clamp"], ["stl ss conn STEEL SET SCREW", "conduit clamp HANGER CLAMP", "hanger clamp CONDUIT CLAMP", "spring nut CHANNEL NUT WITH SPRING", "grc hub CONDUIT HUB", "flex conn SQUEEZE CONNECTOR", "clamp"], lambda t: T.expand_phrases(t, T.tokens(t)))
_rule("f28_bare_category", ["3/4 pvc", "emt 10 ft", "steel strut", "pvc elbow", "pvc emt", "2 in", "whip 6 ft"], ["PVC", "EMT", "STRUT", None, None, None, "WHIP"], lambda t: T.bare_category(T.tokens(t)))
_rule("f28_expanded", ["3/4 pvc", "emt 10 ft", "channel", "pvc elbow", "lt", "grc"], ["3/4 pvc SCH40 BE CONDUIT GRAY RIGID", "emt 10 ft CONDUIT 10 FT", "channel 10 FT PG", "pvc elbow", "lt LIQUID TIGHT", "grc GALVANIZED RIGID CONDUIT 10 FT"], lambda t: T.expand_category(t, T.bare_category(T.tokens(t))))
_rule("f30_reduced", ["pvc gray conduit 3/4", "emt conduit 10 ft", "pvc elbow conduit", "flex conduit"], ["PVC|3/4", "EMT|10|FT", "PVC|ELBOW|CONDUIT", "FLEX"], lambda t: F.array_join(T.reduce_category(T.tokens(t), T.bare_category(T.tokens(t))), "|"))
_rule("f31_tray", ["ladder tray 12 wide", "basket tray wide", "ladder 12 wide", "tray 3/4 deep x", "tray 1.5 tall long"], ["TRAY|12", "TRAY|WIDE", "LADDER|12|WIDE", "TRAY|3/4", "TRAY|1.5|LONG"], lambda t: F.array_join(T.reduce_tray(T.tokens(t)), "|"))
_rule("f35_distinctive", ["10 2 x9 ab abc", "4 3/4", "4 abc", "0.5 ab", "7"], ["10|2|abc", "3/4", "4|abc", "0.5", "7"], lambda t: F.array_join(T.distinctive(F.split(t, " ")), "|"))
_rule("f40_spring", ["spring nut|NUT NO SPRING", "spring nut|NUT", "nut|NUT NO SPRING", "stainless nut|STAINLESS NUT", "nut|STAINLESS NUT", "stainless nut|NUT"], [True, False, False, False, True, True], lambda t: T.variant_conflict(F.split_part(t, F.lit("|"), F.lit(1)), T.canonical_words(F.split_part(t, F.lit("|"), F.lit(1))), T.tokens(F.split_part(t, F.lit("|"), F.lit(1))), F.split_part(t, F.lit("|"), F.lit(2)), T.marker_text(F.split_part(t, F.lit("|"), F.lit(2)))), "")
_rule("f39_default_color", ["pvc elbow", "orange pvc", "emt", "GREY pvc", "x pvc y"], ["GRAY", None, None, None, "GRAY"], lambda t: T.default_color(T.tokens(t)))
_rule("f39_color_conflict", ["orange elbow", "gray elbow", "elbow", "gray and blue"], [True, False, False, True], lambda t: T.color_conflict(T.tokens(t), F.lit("gray")), "")
_MARKED = ["pvc|PVC ELBOW", "pvc elbow|PVC ELBOW", "grc hub|RIGID HUB", "hub|RIGID HUB", "couplings|COUPLING", "hub|HUB ELBOWS, COUPLINGS AND NIPPLES (ECN)", "emt|EMT CONNECTOR", "connector|CONN", "bolt|STRAP IMC"]
_rule("f41_markers", _MARKED, ["ELBOW", None, None, "RIGID", None, None, "CONN", None, "IMC"], lambda t: T.specialty_marker(F.split_part(t, F.lit("|"), F.lit(1)), T.canonical_words(F.split_part(t, F.lit("|"), F.lit(1))), T.marker_text(F.split_part(t, F.lit("|"), F.lit(2)))))
_rule("p2_blank_numbers", ["AB - x - y", " - x", "- - x", "AB-x", "", None, "-", "A B  - c"], ["AB", None, None, None, None, None, None, "A B"], ingest.catalog_number)
_rule("p8_total_rows", ["Sub total", "subtotal: 5", "Grand  Total", "totals", "totally", "total", "sub-total", "x"], [True, True, True, True, False, True, True, False], ingest.is_total_row, "")
_rule("p3_folded", ["a  b", "a  b ", "–x−", "", " ", "a\tb"], ["a b", "a b", "-x-", "", "", "a b"], T.fold)
_rule("n2_all_dimensions", ["3-1/2 in x", "3 1/2\"", "3/4 inch", "0.75\" x", ".5 in", "2 feet", "3'", "1-1/2 x", "3/4 x", "Sch 40/80", "16/2", "2/0", "plain 12", "12 in 12\" 1 ft"], ["3.500000IN", "3.500000IN", "0.750000IN", "0.750000IN", "0.500000IN", "2.000000FT", "3.000000FT", "1.500000IN", "0.750000IN", "", "", "", "", "12.000000IN|1.000000FT"], lambda t: F.array_join(F.transform(U.dimensions(t), lambda x: x["key"]), "|"))
_rule("n3_all_amperes", ["30A", "30 amps x", "1.5 AMP", "30AB", "20 amperes 20 A", "a 5"], ["30.0", "30.0", "1.5", "", "20.0", ""], lambda t: F.array_join(F.transform(U.amperages(t), lambda x: x.cast("string")), "|"))
_rule("n1_all_volts", ["120V", "4.16 KV AC", "2 kilovolts", "24 VDC", "480 volts ac", "120V 120 volt 240V", "12VX", "5 voltage"], ["120", "4160AC", "2000", "24DC", "480AC", "120|240", "", "5"], lambda t: F.array_join(F.transform(U.voltages(t), lambda v: F.concat_ws("", v["volts"].cast("string"), v["polarity"])), "|"))
_rule("f42_attributes", ["120V switch module 3/4\" 20A", "lighting whip", "plain"], ["phrase:SWITCH MODULE|token:120|token:V", "phrase:LIGHTING WHIP|token:LIGHTING|token:WHIP", "token:PLAIN"], lambda t: F.array_join(F.filter(score.attributes(T.tokens(t), U.voltages(F.lit("")), U.dimensions(F.lit("")), U.amperages(F.lit(""))), lambda x: x.startswith("phrase") | x.isin("token:120", "token:V", "token:LIGHTING", "token:WHIP", "token:PLAIN")), "|"))
_rule("f36_plain_kinds", ["120V 3/4 x", "x"], ["voltage:120|size:0.750000IN|amperage:5.0", "amperage:5.0"], lambda t: F.array_join(F.filter(score.attributes(T.tokens(F.lit("")), U.voltages(t), U.dimensions(t), U.amperages(F.lit("5 A"))), lambda x: ~x.startswith("token")), "|"))


@_query("p10_all_quantities", f"SELECT p_partkey AS id, {_case(['1200', '3', None, None, None, '2.5', '-4'], quote='')}::double AS quantity, p_partkey % 7 = 4 AS bad FROM part")
def p10(spark, d):
    rows = _part(spark, d, f"{_case(['1,200', '3.0', ' ', None, 'three', '2.5', '-4'])} AS t")
    return rows.select("id", ingest.quantity_value(c("t")).alias("quantity"), ingest.bad_quantity(c("t")).alias("bad"))


@_query("f25_normalized_texts", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'CABLE TRAY' ELSE '' END AS label, CASE p_partkey % 3 WHEN 0 THEN 'EMT P1000 HG' WHEN 1 THEN 'SET SCREW CONNECTOR ' || p_name ELSE 'Café ' || p_name END AS text FROM part")
def f25(spark, d):
    text = "CASE p_partkey % 3 WHEN 0 THEN 'Cable Tray:  electrical metallic  tubing P-1000HG' WHEN 1 THEN concat('ss conn ', p_name) ELSE concat('Café  ', p_name) END AS requested_description"
    rows = match.normalized(A.read(spark, d, "part").selectExpr("p_partkey AS line_id", text))
    return rows.select(c("line_id").alias("id"), F.array_join("label", " ").alias("label"), "text")


_GROUPS = ["3/4 pvc", "flex conn 10/3", "stl clamp conduit", "cables 007", "2 in"]
_FOUND = ["3/4;plastic,pvc;sch40", "flex,flexible,fmc,squeeze;conn,connector,connectors;10-3,10/3", "steel,stl;clamp;conduit,hanger", "cable,cables,cbl;7", "2"]


@_query("f36_position_groups", f"SELECT p_partkey AS line_id, {_case(_FOUND)} AS groups FROM part")
def f36(spark, d):
    """Spellings of each position: synonyms, interchangeable words, gauges both ways, implied words, leading zeros off."""
    asked = _part(spark, d, f"{_case(_GROUPS)} AS query").withColumnRenamed("id", "line_id")
    return retrieve.with_groups(asked).select("line_id", F.array_join(F.transform("groups", lambda g: F.array_join(g, ",")), ";").alias("groups"))


@_query("f29_widened", f"SELECT p_partkey AS line_id, {_case(['3/4 pvc SCH40 BE CONDUIT GRAY RIGID', 'ONE HOLE strap', 'conduit clamp HANGER CLAMP', 'bolt'])} AS wide FROM part")
def f29(spark, d):
    rows = _part(spark, d, f"{_case(['3/4 pvc', '1-H strap', 'conduit clamp', 'bolt'])} AS query").withColumnRenamed("id", "line_id")
    return match.widened(rows).select("line_id", "wide")


@_query("f38_blobs", f"{A.cte('catalog', 'products')} SELECT id AS product_id, concat_ws(' ', trim(name), description, description2) AS blob, lower(concat_ws(' ', trim(name), description, description2)) AS search_text FROM products")
def f38(spark, d):
    return catalog_index(ingest.products(A.catalog(spark, d))).search.select("product_id", "blob", "search_text")


@_query("j10_sized_first", "SELECT line_id, product_id, row_number() OVER (PARTITION BY line_id ORDER BY same DESC, rank) AS rank FROM (SELECT p_partkey % 20 AS line_id, p_partkey AS product_id, p_partkey % 3 = 0 AS same, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS rank FROM part) QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY same DESC, rank) <= 30")
def j10(spark, d):
    """Rows of the size asked for first, feet or inches alike, else as they were; thirty stay."""
    rows = A.read(spark, d, "part").selectExpr("p_partkey % 20 AS line_id", "p_partkey AS product_id", "row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS rank", "CASE WHEN p_partkey % 3 = 0 THEN '2 ft' WHEN p_partkey % 3 = 1 THEN '3 in' ELSE '' END AS t")
    rows = rows.select("line_id", "product_id", "rank", U.dimensions(F.lit("2 in pipe")).alias("query_dims"), U.dimensions(c("t")).alias("product_dims"))
    return retrieve.sized_first(rows).select("line_id", "product_id", "rank")


_HITS = ["AB123|AB-123 X|", "AB1|AB-1|", "LT 12|LT12|", "X|XX|", "QQ 77|AB|", "AB 12 STEEL|AB12|STEEL"]


@_query("j7_identifier_hit", f"SELECT p_partkey AS id, {_case(['true', 'false', 'true', 'false', 'false', 'true'], quote='')} AS hit FROM part")
def j7(spark, d):
    part = lambda i: F.split_part(c("t"), F.lit("|"), F.lit(i))
    return _part(spark, d, f"{_case(_HITS)} AS t").select("id", retrieve.identifier_hit(part(1), [part(2), part(3)]).alias("hit"))


@_query("j8_description_hits", "WITH t AS (SELECT p_partkey AS id, string_split(p_name || ' ' || p_type, ' ') AS w, p_name, p_type FROM part), a AS (SELECT min(id) AS line_id, list_filter(any_value(w), lambda x: length(x) >= 3) AS d FROM t GROUP BY p_name, p_type), m AS (SELECT line_id, id AS product_id, len(d) AS n, len(list_filter(d, lambda x: list_contains(t.w, x))) AS k FROM a, t) SELECT line_id, product_id FROM m WHERE n >= 2 AND CASE WHEN n >= 4 THEN k >= 3 ELSE k >= 2 AND k / n >= 0.5 END")
def j8(spark, d):
    part = A.read(spark, d, "part")
    rows = part.select(c("p_partkey").alias("product_id"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("tokens"), U.voltages(F.lit("")).alias("volts"))
    asked = part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("line_id")).select("line_id", F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("tokens"), U.voltages(F.lit("")).alias("volts"))
    return retrieve.description_candidates(asked, rows)


# --- scores of fields and decisions
@_query("c8_field_scores", f"{A.cte('catalog', 'products')} SELECT id AS line_id, CASE id % 3 WHEN 0 THEN 'exact' ELSE 'none' END AS ident_type, CASE id % 3 WHEN 2 THEN 0.0 ELSE 100.0 END::double AS score, CASE id % 3 WHEN 0 THEN 'productcode' WHEN 1 THEN 'description' END AS matched_field, CASE id % 3 WHEN 2 THEN 0.0 ELSE 100.0 END::double AS best FROM products")
def c8(spark, d):
    """A row asked by its code, by its own description, and by nothing it has."""
    goods = ingest.products(A.catalog(spark, d))
    query = F.expr("CASE product_id % 3 WHEN 0 THEN product_code WHEN 1 THEN description ELSE '??' END")
    asked = goods.select(c("product_id").alias("line_id"), query.alias("query"), query.alias("wide"))
    rows = match.field_scores(asked, goods.select(c("product_id").alias("line_id"), "product_id"), catalog_index(goods))
    best = F.greatest(*(c(f"fields.{n}") for n in ("productcode", "name", "description", "description2")))
    return rows.select("line_id", "ident_type", "score", "matched_field", best.alias("best"))


@_query("c11_floors", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 92.0 WHEN 1 THEN 40.0 WHEN 2 THEN 60.0 WHEN 3 THEN 96.0 ELSE 78.0 END::double AS value FROM part")
def c11(spark, d):
    """Equal sizes in order lift a covered text to 92, a conflict caps at 40, coverage alone lifts to itself, 92 is no cap, and a partial code stays below 78."""
    rows = _part(spark, d, "CASE p_partkey % 5 WHEN 3 THEN 96D ELSE 60D END AS coverage", "p_partkey % 5 = 1 AS conflict", "p_partkey % 5 IN (0, 3) AS dims", "CASE p_partkey % 5 WHEN 4 THEN 'partial' ELSE 'none' END AS kind", "CASE WHEN p_partkey % 5 IN (1, 4) THEN 100D ELSE 10D END AS s")
    numeric = F.when(c("conflict"), 0.0)
    return rows.select("id", score.confidence(c("kind"), c("s"), c("s"), c("s"), c("s"), numeric, c("conflict"), c("coverage"), c("dims")).alias("value"))


@_query("c7_token_codes", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'partial' ELSE 'none' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 62.0 WHEN 1 THEN 54.0 ELSE 0.0 END::double AS score FROM part")
def c7(spark, d):
    """Words within a code: all of them beside one more; three of four beside one more; two of three; a general word; too short."""
    pairs = ["LT12 AB34|AB34 LT12 Z9", "LT12 AB34 QQ77 ZZ88|QQ77 LT12 AB34 Z9", "LT12 AB34 QQ77|AB34 LT12 Z9", "AB|AB CD", "A1 B|X A1 B"]
    rows = _part(spark, d, f"{_case(pairs)} AS t").select("id", F.split_part(c("t"), F.lit("|"), F.lit(1)).alias("a"), F.split_part(c("t"), F.lit("|"), F.lit(2)).alias("b"))
    rows = score.identity(score.coded(score.coded(rows, "a", "q"), "b", "c"), "q", "c", "found")
    return rows.select("id", c("found.type").alias("kind"), c("found.score").alias("score"))


_IDENT = "named_struct('score', 0D, 'type', 'none', 'query_compact', '', 'catalog_compact', '', 'extra', cast(array() AS array<string>))"


def _pool(spark, d):
    """Candidates of eight kinds of lines, as `plans.match.by_text` gives them."""
    code = "named_struct('score', 100D, 'type', '{t}', 'query_compact', 'AB12', 'catalog_compact', 'AB12{x}', 'extra', cast(array() AS array<string>))"
    one = "CASE k WHEN 0 THEN 100 WHEN 1 THEN 100 WHEN 2 THEN 91 WHEN 3 THEN 95 WHEN 4 THEN 95 WHEN 5 THEN 3 ELSE 100 END"
    two = "CASE k WHEN 0 THEN 50 WHEN 1 THEN 50 WHEN 2 THEN 90.5 WHEN 3 THEN 80 WHEN 4 THEN 92 WHEN 5 THEN 1 ELSE 70 END"

    def item(n: int, score_: str) -> str:
        kind = f"CASE WHEN k = 7 THEN '{'exact' if n == 1 else 'partial'}' ELSE 'none' END"
        ident = f"CASE WHEN k = 7 THEN {code.format(t='exact' if n == 1 else 'partial', x='' if n == 1 else 'X')} ELSE {_IDENT} END"
        exact = f"CASE WHEN k IN (0, 1, 7) AND {n} = 1 THEN 100D ELSE 0D END"
        return f"named_struct('n', {n}, 'score', cast({score_} AS double), 'exact', {exact}, 'ident', {ident}, 'ident_type', {kind}, 'canonical', CASE WHEN k = 2 THEN 'SAME' ELSE 'C{n}' END)"

    rows = A.read(spark, d, "part").selectExpr("p_partkey AS line_id", "p_partkey % 8 AS k").where("k <> 6").selectExpr("line_id", "k", f"explode(array({item(1, one)}, {item(2, two)})) AS x").select("line_id", "k", "x.*")
    fields = "named_struct('productcode', CASE WHEN k = 7 THEN 100D ELSE 0D END, 'name', 0D, 'description', score, 'description2', 0D) AS fields"
    evidence = "named_struct('match_type', ident_type, 'matching_tokens', cast(array() AS array<string>), 'additional_catalog_tokens', cast(array() AS array<string>), 'normalized_terms', cast(array() AS array<string>), 'unit_lines', cast(array() AS array<string>), 'numeric_unit_score', 0D, 'numeric_conflict', false) AS evidence"
    return rows.selectExpr("line_id", "concat('id', n) AS product_id", "concat('E', n) AS external_id", "concat('K', line_id, '-', n) AS product_code", "cast(null AS string) AS orderable", "'nm' AS name", "'ds' AS description", "'d2' AS description2", "canonical", "score", "exact", "ident", "ident_type", "CASE WHEN k = 7 THEN 'productcode' END AS ident_field", "false AS numeric_conflict", fields, "array('why') AS reasons", evidence)


_DECIDED = """CASE p_partkey % 8 WHEN 0 THEN 'EXACT_MATCH' WHEN 3 THEN 'HIGH_CONFIDENCE' WHEN 5 THEN 'NO_MATCH' WHEN 6 THEN 'NO_MATCH' ELSE 'REVIEW_REQUIRED' END"""


@_query("d4_decided", f"SELECT p_partkey AS line_id, {_DECIDED} AS status, CASE p_partkey % 8 WHEN 0 THEN 100.0 WHEN 1 THEN 30.0 WHEN 3 THEN 95.0 WHEN 5 THEN 3.0 WHEN 6 THEN 0.0 ELSE 86.0 END::double AS percentage, CASE WHEN p_partkey % 8 IN (0, 3) THEN 'K' || p_partkey || '-1' END AS matched_part, CASE p_partkey % 8 WHEN 1 THEN 0.0 WHEN 7 THEN 100.0 END::double AS part_number_score, p_partkey % 8 = 7 AS part_number_match, p_partkey % 8 NOT IN (5, 6, 7) AS description_match, CASE p_partkey % 8 WHEN 0 THEN 'Description matched a unique catalog product.' WHEN 1 THEN 'first' WHEN 2 THEN 'Description matched multiple catalog products. A part number or additional product attributes are required.' WHEN 3 THEN 'Description matched a unique catalog product.' WHEN 4 THEN 'Score gap 3.00 is below the configured separation 5.00' WHEN 5 THEN 'Top score 3.00 is below the minimum match threshold 5.00' WHEN 6 THEN 'No catalog product reached the candidate floor' ELSE 'Multiple possible Productcode matches' END AS reason FROM part")
def d4(spark, d):
    """One exact text; the same under review by a code that is unknown; equal texts; a clear best; a close second; a poor best; none; competing codes."""
    lines = A.read(spark, d, "part").selectExpr("p_partkey AS line_id", "p_partkey % 8 = 1 AS force_review", "CASE WHEN p_partkey % 8 = 1 THEN 0D END AS stated_score", "CASE WHEN p_partkey % 8 = 1 THEN array('first') ELSE cast(array() AS array<string>) END AS extra")
    done = decide.decided(_pool(spark, d), lines)
    return done.select("line_id", "status", "percentage", "matched_part", "part_number_score", "part_number_match", "description_match", F.get("reasons", F.lit(0)).alias("reason"))


@_query("d5_named", "SELECT p_partkey AS line_id, CASE p_partkey % 8 WHEN 5 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'EXACT_MATCH' END AS status, CASE p_partkey % 8 WHEN 0 THEN 100.0 WHEN 1 THEN 70.9 WHEN 5 THEN 70.9 ELSE 94.0 END::double AS percentage, CASE WHEN p_partkey % 8 IN (1, 5) THEN 2 ELSE 1 END AS listed, CASE WHEN p_partkey % 8 NOT IN (1, 5) THEN 'K' || p_partkey || '-1' END AS matched_part, CASE p_partkey % 8 WHEN 1 THEN 30.0 WHEN 5 THEN 99.0 END::double AS score_gap, p_partkey % 8 NOT IN (0, 1, 5) AS description_match, CASE WHEN p_partkey % 8 IN (1, 5) THEN 'Exact part number found, but the requested description conflicts with the catalog description. Review required.' WHEN p_partkey % 8 = 0 THEN 'because' ELSE 'Exact part number match and compatible product description.' END AS reason FROM part WHERE p_partkey % 8 <> 6 AND p_partkey % 8 <> 7 UNION ALL SELECT p_partkey, 'EXACT_MATCH', 94.0, 1, 'K' || p_partkey || '-1', NULL, true, 'Exact part number match and compatible product description.' FROM part WHERE p_partkey % 8 = 7")
def d5(spark, d):
    """A named row alone, beside a conflicting text (others follow), and beside a compatible one."""
    pool = _pool(spark, d).withColumn("k", c("line_id") % 8)
    first = pool.where("product_id = 'id1'").withColumns({"score": F.lit(100.0), "blank": c("k") == 0, "conflict": c("k").isin(1, 5), "compatible": ~c("k").isin(1, 5), "description_score": F.when(c("k") == 0, F.lit(None)).when(c("k").isin(1, 5), 3.0).otherwise(80.0).cast("double"), "why": F.lit("because")})
    rest = decide.shaped(decide.ranked(pool.where("product_id = 'id2'").withColumn("score", F.when(c("k") == 1, 70.0).otherwise(c("score"))))).groupBy("line_id").agg(F.collect_list("shape").alias("candidates"))
    done = decide.named(first.drop("k"), rest)
    return done.select("line_id", "status", "percentage", F.size("candidates").alias("listed"), "matched_part", "score_gap", "description_match", F.get("reasons", F.lit(0)).alias("reason"))


@_query("k2_published", "SELECT p_partkey AS line_id, n::int AS candidate_count, CASE WHEN p_partkey % 3 = 1 THEN 'Automatic — Description Match' END AS match_type_label, array_to_string(range(1, n + 1), ',') AS ranks FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE least(6, p_partkey % 9) END AS n FROM part)")
def k2(spark, d):
    """Six candidates at most, numbered; none of a line without a match."""
    shape = decide.shaped(decide.ranked(_pool(spark, d).where("product_id = 'id1'"))).select("line_id", "shape")
    one = shape.limit(1).select("shape")
    rows = A.read(spark, d, "part").selectExpr("p_partkey AS line_id", "p_partkey % 9 AS n", "element_at(array('NO_MATCH', 'HIGH_CONFIDENCE', 'REVIEW_REQUIRED'), cast(p_partkey % 3 + 1 AS int)) AS status", "array('x') AS reasons", "90D AS percentage", "2D AS second_score", "9D AS score_gap", "false AS part_number_match", "true AS description_match")
    rows = rows.crossJoin(F.broadcast(one)).withColumn("candidates", F.slice(F.array_repeat("shape", 9), F.lit(1), c("n").cast("int"))).drop("shape", "n")
    done = decide.published(rows)
    return done.select("line_id", "candidate_count", "match_type_label", F.array_join(F.transform("candidates", lambda x: x["rank"].cast("string")), ",").alias("ranks"))

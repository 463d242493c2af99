"""Queries over the driver's tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .functions import text as T
from .functions import units as U
from .operators import decide, history, ingest, retrieve, score
from .plans.match import match_lines
from .plans.stages import spread
from .sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _lines(name: str, column: str, expression: Callable[..., object], sql: str) -> None:
    """A query of one expression over every request line."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.lines(spark, sf_dir).select("line_id", expression(F.col("requested_description")).alias(column))

    _query(name, f"{A.cte('lines')} SELECT line_id, {sql} AS {column} FROM (SELECT *, requested_description AS t FROM lines)")(run)


# --- scans and row rules
@_query("s1_catalog_scan", A.cte("catalog") + " SELECT id, productcode, name, description FROM catalog WHERE trim(coalesce(name, '')) NOT IN ('', '-')")
def s1(spark, d):
    return A.catalog(spark, d).where("trim(coalesce(name, '')) NOT IN ('', '-')").select("id", "productcode", "name", "description")


@_query("s2_product_rows", A.cte("catalog", "products") + " SELECT id AS product_id, trim(name) AS product_code, nullif(trim(orderablepartnumber), '') AS orderable, lower(trim(preferredflag)) = 'preferred' AS preferred FROM products")
def s2(spark, d):
    return ingest.products(A.catalog(spark, d)).select("product_id", "product_code", "orderable", "preferred")


@_query("s10_sample", A.cte("catalog") + " SELECT * FROM catalog ORDER BY id LIMIT 5")
def s10(spark, d):
    return ingest.sample_rows(A.catalog(spark, d))


@_query("s11_codes", A.cte("catalog") + ", c AS (SELECT cast(p_partkey AS string) AS code FROM part WHERE p_size = 7 UNION SELECT upper(concat(cast(p_size AS string), '\" ', p_name, ' ', p_type)) FROM part WHERE p_size = 9) SELECT id, name FROM catalog WHERE productcode IN (SELECT code FROM c) OR name IN (SELECT code FROM c) OR description IN (SELECT code FROM c) OR description2 IN (SELECT code FROM c)")
def s11(spark, d):
    part = A.read(spark, d, "part")
    codes = part.where("p_size = 7").selectExpr("cast(p_partkey AS string) AS code").union(part.where("p_size = 9").selectExpr("upper(concat(cast(p_size AS string), '\" ', p_name, ' ', p_type)) AS code"))
    return ingest.rows_with_codes(A.catalog(spark, d), codes).select("id", "name")


@_query("s18_profile", "SELECT 'p_name' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE p_name IS NULL OR trim(p_name) = '') AS missing, count(DISTINCT p_name) AS \"values\", cast(max(length(p_name)) AS bigint) AS longest FROM part UNION ALL SELECT 'p_brand', count(*), count(*) FILTER (WHERE p_brand IS NULL OR trim(p_brand) = ''), count(DISTINCT p_brand), max(length(p_brand)) FROM part")
def s18(spark, d):
    return ingest.column_profile(A.read(spark, d, "part").select("p_name", "p_brand"))


@_query("p1_classify", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN 'product' WHEN p_partkey % 3 <> 0 AND p_partkey % 5 = 0 THEN 'family' ELSE 'invalid' END AS kind FROM part")
def p1(spark, d):
    code = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat('NA1-', p_name) ELSE p_name END")
    number = F.expr("CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE p_brand END")
    filled = F.expr("CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE p_type END")
    return A.read(spark, d, "part").select("p_partkey", ingest.record_class(code, number, filled, filled).alias("kind"))


@_query("p2_catalog_number", "SELECT p_partkey, p_brand AS number FROM part")
def p2(spark, d):
    return A.read(spark, d, "part").select("p_partkey", ingest.catalog_number(F.concat_ws(" - ", "p_brand", "p_name", "p_type")).alias("number"))


@_query("p4_headers", "SELECT DISTINCT event_type, lower(replace(event_type, '_', ' ')) AS header, regexp_replace(lower(event_type), '[^a-z0-9]', '', 'g') AS key FROM events")
def p4(spark, d):
    return A.read(spark, d, "events").select("event_type").distinct().select("event_type", ingest.header_text(F.col("event_type")).alias("header"), ingest.header_key(F.col("event_type")).alias("key"))


@_query("p8_totals", "SELECT count(*) AS rows, count(*) FILTER (WHERE regexp_matches(text, '(?i)\\b(sub[- ]?total|grand\\s+total|totals?)\\b')) AS totals FROM documents")
def p8(spark, d):
    return A.read(spark, d, "documents").agg(F.count(F.lit(1)).alias("rows"), F.count_if(ingest.is_total_row(F.col("text"))).alias("totals"))


@_query("p10_quantity", "SELECT l_orderkey, l_linenumber, l_partkey, try_cast(replace(format('{:,d}', cast(l_quantity AS bigint) * 1000), ',', '') AS double) AS quantity FROM lineitem")
def p10(spark, d):
    text = F.format_number(F.col("l_quantity").cast("bigint") * 1000, 0)
    return A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ingest.quantity_value(text).alias("quantity"))


@_query("p12_numbered_headers", "SELECT p_brand AS file, p_partkey AS col, CASE WHEN row_number() OVER w > 1 THEN concat(p_name, ' (', row_number() OVER w, ')') ELSE p_name END AS header FROM part WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_partkey)")
def p12(spark, d):
    return ingest.numbered_headers(A.read(spark, d, "part").selectExpr("p_brand AS file", "p_partkey AS col", "p_name AS name")).select("file", "col", "header")


# --- text functions over request lines
_FOLDED = "trim(regexp_replace(t, '\\s+', ' ', 'g'))"
_COMPACT = "regexp_replace(upper(t), '[^A-Z0-9]+', '', 'g')"
_WORDS = "list_filter(string_split(upper(trim(regexp_replace(t, '\\s+', ' ', 'g'))), ' '), lambda w: w <> '')"
_PROSE = f"list_any_value(list_filter({_WORDS}, lambda w: list_contains({_list(vocab.PROSE)}, trim(w, ':,;.')))) IS NOT NULL"
_lines("f1_fold", "folded", T.fold, _FOLDED)
_lines("f8_compact", "compact", T.compact, _COMPACT)
_lines("f8_words", "words", lambda c: F.array_join(T.code_words(c), "|"), f"array_to_string({_WORDS}, '|')")
_lines("f10_code_query", "is_code", T.is_code_query, f"len({_WORDS}) BETWEEN 1 AND 6 AND NOT ({_PROSE})")
_lines("f11_code_like", "code_like", T.is_code_like, f"len({_WORDS}) BETWEEN 1 AND 8 AND NOT ({_PROSE}) AND regexp_matches({_COMPACT}, '[0-9]')")
_KEY = "regexp_replace(regexp_replace(upper(trim(t)), '\\s*([/._+-])\\s*', '\\1', 'g'), '\\s+', '', 'g')"
_lines("f3_part_number", "part_number", T.part_number, f"trim({_KEY}, ':\"''(),;.')")
_lines("f4_lookup_keys", "keys", lambda c: F.array_join(T.lookup_keys(c), "|"), f"(SELECT CASE WHEN k LIKE 'NA1-%' THEN concat(k, '|', substr(k, 5)) ELSE concat(k, '|NA1-', k) END FROM (SELECT trim({_KEY}, ':\"''(),;.') AS k))")
_lines("f22_label", "label", lambda c: F.array_join(T.label_words(c), " "), "upper(regexp_extract(t, '^\\s*([A-Za-z]+(?:\\s+[A-Za-z]+){0,2})\\s*:\\s*', 1))")
_lines("f24_acronyms", "text", lambda c: T.acronyms(F.regexp_replace(c, "ring", "waterfall")), "replace(replace(t, 'ring', 'DROP OUT'), 'waterfall', 'DROP OUT')")
_lines("f26_hole_count", "text", lambda c: T.hole_count(F.concat(c, F.lit(" 1-H 2h"))), "concat(t, ' ONE HOLE TWO HOLE')")
_NOISE = f"array_to_string(list_filter(regexp_extract_all(t, '\\.?[A-Za-z0-9]+(?:/[A-Za-z0-9]+)*(?:[\"″”''′])?'), lambda w: NOT list_contains({_list(vocab.NOISE)}, upper(w))), ' ')"
_lines("f20_noise", "text", T.without_noise, _NOISE)
_lines("f18_quantity", "said", lambda c: T.quantity(T.fold(c)), "coalesce(try_cast(nullif(regexp_extract(t, '(?i)\\bquote\\s+(\\d+)\\b', 1), '') AS int), try_cast(nullif(regexp_extract(t, '(?i)\\b(?:qty|quantity)\\s*[:=]?\\s*(\\d+)\\b', 1), '') AS int))")
_lines("f34_leading_zero", "words", lambda c: F.array_join(F.transform(T.code_words(c), T.strip_zero), "|"), f"array_to_string(list_transform({_WORDS}, lambda w: CASE WHEN regexp_matches(w, '^[0-9]+$') THEN regexp_replace(w, '^0+(\\d)', '\\1') ELSE w END), '|')")
_lines("f40_stainless", "flag", lambda c: F.contains(F.upper(c), F.lit("STAINLESS")), "contains(upper(t), 'STAINLESS')")


@_query("f9_generic", "SELECT DISTINCT p_type, length(p_type) <= 2 AS generic FROM part UNION SELECT DISTINCT substr(p_type, 1, 2), true FROM part")
def f9(spark, d):
    part = A.read(spark, d, "part")
    words = part.select("p_type").union(part.selectExpr("substr(p_type, 1, 2)")).distinct()
    return words.select("p_type", T.is_generic(F.col("p_type")).alias("generic"))


@_query("f12_embedded_hits", A.cte("lines", "catalog") + f" SELECT line_id, array_to_string(list_filter({_WORDS.replace('t,', 'requested_description,')}, lambda w: length(regexp_replace(w, '[^A-Z0-9]', '', 'g')) >= 2 AND contains(regexp_replace(upper(description), '[^A-Z0-9]+', '', 'g'), regexp_replace(w, '[^A-Z0-9]', '', 'g'))), '|') AS hits FROM lines JOIN catalog ON line_id = id")
def f12(spark, d):
    both = A.lines(spark, d).join(A.catalog(spark, d), F.col("line_id") == F.col("id"))
    return both.select("line_id", F.array_join(T.embedded_hits(F.col("requested_description"), F.col("description")), "|").alias("hits"))


@_query("f17_synonyms", f"SELECT word, coalesce(m[word], word) AS canonical FROM (SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) AS word FROM part UNION SELECT unnest({_list(sorted(vocab.CANONICAL))})), (SELECT map({_list(list(vocab.CANONICAL))}, {_list(list(vocab.CANONICAL.values()))}) AS m)")
def f17(spark, d):
    seen = A.read(spark, d, "part").select(F.explode(F.split(F.upper("p_name"), " ")).alias("word"))
    words = seen.union(spark.createDataFrame([(w,) for w in vocab.CANONICAL], "word string")).distinct()
    return words.select("word", F.coalesce(T.lookup(vocab.CANONICAL)[F.col("word")], F.col("word")).alias("canonical"))


@_query("f33_gauge", "SELECT a, b, CASE WHEN a % b <> 0 AND b IN (2, 4, 8, 16, 32, 64) THEN NULL ELSE concat(a, '-', b) END AS variant FROM (SELECT DISTINCT p_size AS a, cast(p_partkey % 20 AS int) + 1 AS b FROM part)")
def f33(spark, d):
    pairs = A.read(spark, d, "part").selectExpr("p_size AS a", "cast(p_partkey % 20 AS int) + 1 AS b").distinct()
    return pairs.select("a", "b", T.gauge_variant(F.concat_ws("/", "a", "b")).alias("variant"))


@_query("n3_amperes", "SELECT p_partkey, cast(p_size AS double) AS amps FROM part")
def n3(spark, d):
    return A.read(spark, d, "part").select("p_partkey", F.get(U.amperages(F.concat(F.lit("BOX "), F.col("p_size"), F.lit(" AMP x"))), F.lit(0)).alias("amps"))


@_query("n1_volts", "SELECT p_partkey, p_size * 1000 AS volts, CASE WHEN p_partkey % 2 = 0 THEN 'AC' END AS polarity FROM part")
def n1(spark, d):
    text = F.concat(F.lit("FEED "), F.col("p_size"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'KVAC' ELSE ' kV' END"), F.lit(" RUN"))
    first = F.get(U.voltages(text), F.lit(0))
    return A.read(spark, d, "part").select("p_partkey", first["volts"].alias("volts"), first["polarity"].alias("polarity"))


@_query("n2_dimensions", A.cte("catalog") + " SELECT id, concat(regexp_extract(description, '^(\\d+)', 1), '.000000IN') AS sizes FROM catalog")
def n2(spark, d):
    return spread(A.catalog(spark, d)).select("id", F.array_join(F.transform(U.dimensions(F.col("description")), lambda x: x["key"]), "|").alias("sizes"))


@_query("n4_pairs", "SELECT p_partkey, cast(p_size AS double) AS a, cast(p_partkey % 9 AS double) AS b FROM part")
def n4(spark, d):
    first = F.get(U.number_pairs(F.concat(F.lit("BASE "), F.col("p_size"), F.lit(" x "), F.expr("p_partkey % 9"), F.lit(" SET"))), F.lit(0))
    return A.read(spark, d, "part").select("p_partkey", first["a"].alias("a"), first["b"].alias("b"))


@_query("n5_plausible", "SELECT DISTINCT p_size AS a, cast(p_partkey % 66 AS int) AS b, CASE WHEN p_partkey % 66 = 0 THEN false ELSE p_size % cast(p_partkey % 66 AS int) <> 0 AND p_partkey % 66 IN (2, 4, 8, 16, 32, 64) END AS ok FROM part")
def n5(spark, d):
    pairs = A.read(spark, d, "part").selectExpr("p_size AS a", "cast(p_partkey % 66 AS int) AS b").distinct()
    return pairs.select("a", "b", F.coalesce(T.plausible_fraction(F.col("a"), F.col("b")), F.lit(False)).alias("ok"))


@_query("n10_percent", "SELECT p_partkey, CASE WHEN v = floor(v) THEN cast(cast(v AS bigint) AS string) ELSE rtrim(rtrim(printf('%.2f', v), '0'), '.') END AS shown FROM (SELECT p_partkey, p_size / 4.0::double AS v FROM part)")
def n10(spark, d):
    return A.read(spark, d, "part").select("p_partkey", T.percent_text(F.col("p_size") / F.lit(4.0)).alias("shown"))


# --- purchase history
for _key, _where in (("shipto", "shipto IS NOT NULL"), ("billto", "billto IS NOT NULL"), ("billtoname", "trim(billtoname) <> ''")):
    _run = {"shipto": history.by_shipto, "billto": history.by_billto, "billtoname": history.by_name}[_key]
    _query(f"a1_by_{_key}", A.cte("sales") + f" SELECT {_key}, trim(itemnumber) AS item_number, cast(sum(orderquantity) AS bigint) AS total_quantity FROM sales WHERE {_where} AND trim(itemnumber) <> '' GROUP BY 1, 2")(lambda spark, d, f=_run: f(A.sales(spark, d)))


@_query("a11_record_counts", A.cte("catalog") + " SELECT lower(record_type) AS kind, count(*) AS n FROM catalog GROUP BY 1")
def a11(spark, d):
    return ingest.record_counts(A.catalog(spark, d))


@_query("a6_duplicates", A.cte("catalog", "products") + " SELECT id AS product_id, count(*) OVER (PARTITION BY description) AS copies FROM products")
def a6(spark, d):
    return ingest.with_copies(ingest.products(A.catalog(spark, d))).select("product_id", "copies")


_POOL = "pool AS (SELECT DISTINCT line_id, customer_name, coalesce(orderablepartnumber, name) AS code FROM lines JOIN part p ON p.p_partkey = line_id JOIN part o ON o.p_name = p.p_name JOIN catalog ON catalog.id = o.p_partkey AND name <> '-' WHERE customer_name IS NOT NULL)"
_TIERS = """s1 AS (SELECT shipto AS k, trim(itemnumber) AS code, sum(orderquantity) AS q FROM sales GROUP BY 1, 2), s2 AS (SELECT billto AS k, trim(itemnumber) AS code, sum(orderquantity) AS q FROM sales GROUP BY 1, 2),
    s3 AS (SELECT billtoname AS k, trim(itemnumber) AS code, sum(orderquantity) AS q FROM sales GROUP BY 1, 2),
    hits AS (SELECT line_id, pool.code, 1 AS tier, q FROM pool JOIN s1 ON try_cast(customer_name AS bigint) = k AND pool.code = s1.code UNION ALL SELECT line_id, pool.code, 2, q FROM pool JOIN s2 ON try_cast(customer_name AS bigint) = k AND pool.code = s2.code
      UNION ALL SELECT line_id, pool.code, 3, sum(q) FROM pool JOIN s3 ON contains(lower(k), lower(customer_name)) AND pool.code = s3.code WHERE try_cast(customer_name AS bigint) IS NULL GROUP BY 1, 2)"""


def _bought(spark: SparkSession, d: str) -> DataFrame:
    """What each line's customer bought of all items of the same name: those are the line's pool."""
    names = A.read(spark, d, "part").select("p_partkey", "p_name")
    goods = A.catalog(spark, d).where("name <> '-'").selectExpr("id AS p_partkey", "coalesce(orderablepartnumber, name) AS code").join(names, "p_partkey").select(F.col("p_name").alias("pool"), "code")
    lines = A.lines(spark, d).where("customer_name IS NOT NULL").select(F.col("line_id").alias("p_partkey"), "customer_name").join(names, "p_partkey")
    return history.pooled_purchases(lines.select(F.col("p_partkey").alias("line_id"), "customer_name", F.col("p_name").alias("pool")), goods, A.sales(spark, d))


@_query("j11_purchase_cascade", f"{A.cte('lines', 'catalog', 'sales')}, {_POOL}, {_TIERS} SELECT line_id, code, cast(q AS bigint) AS quantity FROM hits WHERE tier = (SELECT min(tier) FROM hits h WHERE h.line_id = hits.line_id) AND q > 0")
def j11(spark, d):
    return _bought(spark, d).select("line_id", "code", "quantity")


@_query("j12_purchase_shares", f"{A.cte('lines', 'catalog', 'sales')}, {_POOL}, {_TIERS}, won AS (SELECT line_id, code, q FROM hits WHERE tier = (SELECT min(tier) FROM hits h WHERE h.line_id = hits.line_id) AND q > 0) SELECT line_id, code, round(cast(q AS double) / sum(q) OVER (PARTITION BY line_id), 4) AS share FROM won")
def j12(spark, d):
    return _bought(spark, d).select("line_id", "code", F.round("share", 4).alias("share"))


# --- joins
def _requests(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "part").selectExpr("p_partkey AS line_id", f"CASE WHEN p_partkey % 2 = 0 THEN concat(' ', lower({A.CODE})) ELSE concat('NA1-', {A.CODE}) END AS identifier")


@_query("j1_identity", f"{A.cte('catalog', 'products')}, r AS (SELECT p_partkey AS line_id, {A.CODE} AS code FROM part) SELECT line_id, count(*) AS hits, CASE WHEN count(*) = 1 THEN min(id) END AS product_id FROM r JOIN products ON code = trim(name) GROUP BY line_id")
def j1(spark, d):
    return retrieve.identity_matches(_requests(spark, d), ingest.products(A.catalog(spark, d)))


@_query("j2_exact_lookup", f"{A.cte('catalog', 'products')} SELECT p_partkey AS line_id, id AS product_id FROM part JOIN products ON {A.CODE} = name")
def j2(spark, d):
    return retrieve.exact_lookup(_requests(spark, d), ingest.products(A.catalog(spark, d)))


_TEXTS = "(SELECT id AS product_id, lower(concat_ws(' ', name, description, description2)) AS x FROM products)"


@_query("j3_strict_search", f"{A.cte('catalog', 'products')} SELECT p_name, p_type, product_id FROM (SELECT DISTINCT p_name, p_type FROM part), {_TEXTS} WHERE contains(x, split_part(p_name, ' ', 1)) AND contains(x, split_part(p_name, ' ', 2)) AND contains(x, lower(p_type))")
def j3(spark, d):
    asked = A.read(spark, d, "part").select("p_name", "p_type").distinct().withColumn("query", F.concat_ws(" ", "p_name", "p_type")).withColumn("line_id", F.xxhash64("query"))
    found = retrieve.fitting_rows(asked, ingest.products(A.catalog(spark, d))).where("tier = 0")
    return found.join(asked, "line_id").select("p_name", "p_type", "product_id")


@_query("j4_partial_search", f"{A.cte('catalog', 'products')} SELECT p_name, p_type, product_id FROM (SELECT DISTINCT p_name, p_type FROM part), {_TEXTS} WHERE contains(x, split_part(p_name, ' ', 1))::int + contains(x, split_part(p_name, ' ', 2))::int + contains(x, lower(p_type))::int = 2 AND len(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)])) = 3")
def j4(spark, d):
    asked = A.read(spark, d, "part").select("p_name", "p_type").distinct().withColumn("query", F.concat_ws(" ", "p_name", "p_type")).withColumn("line_id", F.xxhash64("query"))
    found = retrieve.fitting_rows(asked, ingest.products(A.catalog(spark, d))).where("tier = 1")
    return found.join(asked, "line_id").select("p_name", "p_type", "product_id")


@_query("j6_identifier_search", f"{A.cte('catalog', 'products')} SELECT p_name, product_id FROM (SELECT DISTINCT p_name FROM part), {_TEXTS} WHERE contains(regexp_replace(x, '[ /-]', '', 'g'), split_part(p_name, ' ', 1)) AND contains(regexp_replace(x, '[ /-]', '', 'g'), split_part(p_name, ' ', 2))")
def j6(spark, d):
    asked = A.read(spark, d, "part").select("p_name").distinct().withColumn("query", F.col("p_name")).withColumn("line_id", F.xxhash64("p_name"))
    return retrieve.identifier_candidates(asked, ingest.products(A.catalog(spark, d)), 1 << 30).join(asked, "line_id").select("p_name", "product_id")


# --- scores and decisions over pairs of parts with neighbouring keys
_PAIR = "(SELECT p.p_partkey AS id, string_split(p.p_name || ' ' || p.p_type, ' ') AS q, string_split(c.p_name || ' ' || c.p_type, ' ') AS c FROM part p JOIN part c ON c.p_partkey = p.p_partkey + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    part = A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("q"))
    return part.join(part.select((F.col("id") - 1).alias("id"), F.col("q").alias("c")), "id")


@_query("c1_exact", f"SELECT id, CASE WHEN list_sort(list_distinct(q)) = list_sort(list_distinct(c)) THEN 100.0::double ELSE 0.0::double END AS exact FROM {_PAIR}")
def c1(spark, d):
    return _pairs(spark, d).select("id", score.exact_score(F.col("q"), F.col("c")).alias("exact"))


@_query("c2_token_coverage", f"SELECT id, round((0.75 * len(list_intersect(q, c)) / len(list_distinct(q)) + 0.25 * len(list_intersect(q, c)) / len(list_distinct(c))) * 100, 2) AS token FROM {_PAIR}")
def c2(spark, d):
    return _pairs(spark, d).select("id", F.round(score.token_score(F.col("q"), F.col("c")), 2).alias("token"))


@_query("c4_jaccard", f"SELECT id, round(100.0 * len(list_intersect(q, c)) / len(list_distinct(list_concat(q, c))), 2) AS attribute FROM {_PAIR}")
def c4(spark, d):
    return _pairs(spark, d).select("id", F.round(score.attribute_score(F.col("q"), F.col("c")), 2).alias("attribute"))


_FOUR = "(SELECT p_partkey AS id, cast(p_size % 2 * 100 AS double) AS e, cast(p_partkey % 101 AS double) AS t, cast(p_partkey * 7 % 101 AS double) AS f, cast(p_partkey * 13 % 101 AS double) AS a FROM part)"


def _four(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "part").selectExpr("p_partkey AS id", "cast(p_size % 2 * 100 AS double) AS e", "cast(p_partkey % 101 AS double) AS t", "cast(p_partkey * 7 % 101 AS double) AS f", "cast(p_partkey * 13 % 101 AS double) AS a")


@_query("c5_final", f"SELECT id, round(least(100, greatest(0.40 * e + 0.25 * t + 0.20 * f + 0.15 * a, 0.70 * t + 0.15 * a + 0.10 * f + 0.05 * e)), 2) AS final FROM {_FOUR}")
def c5(spark, d):
    return _four(spark, d).select("id", F.round(score.final_score(F.col("e"), F.col("t"), F.col("f"), F.col("a")), 2).alias("final"))


@_query("c3_sequence_ratio")
def c3(spark, d):
    pairs = _pairs(spark, d).select(F.array_join("q", " ").alias("left"), F.array_join("c", " ").alias("right"))
    return score.fuzzy_scores(pairs)


@_query("c18_overall", f"SELECT id, round(CASE WHEN t > 50 THEN 0.7 * t + 0.3 * f ELSE f END, 2) AS overall FROM {_FOUR}")
def c18(spark, d):
    return _four(spark, d).select("id", F.round(score.overall(F.when(F.col("t") > 50, F.col("t")), F.col("f")), 2).alias("overall"))


_STATUS = """CASE WHEN n = 0 THEN 'NO_MATCH' WHEN c AND t < 5 THEN 'NO_MATCH' WHEN t < 5 AND i = 'none' THEN 'NO_MATCH' WHEN t < 5 AND i = 'partial' THEN 'REVIEW_REQUIRED' WHEN d THEN 'REVIEW_REQUIRED'
    WHEN u AND i = 'exact' THEN 'EXACT_MATCH' WHEN u AND t >= 99 AND i <> 'partial' THEN 'EXACT_MATCH' WHEN i = 'partial' THEN 'REVIEW_REQUIRED' WHEN c THEN 'REVIEW_REQUIRED'
    WHEN s >= 5 AND t - s < 5 THEN 'REVIEW_REQUIRED' WHEN t >= 90 THEN 'HIGH_CONFIDENCE' WHEN t >= 5 THEN 'REVIEW_REQUIRED' ELSE 'NO_MATCH' END"""
_CASES = "SELECT p_partkey AS id, cast(p_partkey % 101 AS double) AS t, cast(greatest(0, p_partkey % 101 - p_size) AS double) AS s, p_partkey % 17 AS n, p_partkey % 5 = 0 AS c, p_partkey % 7 = 0 AS d, p_partkey % 3 = 0 AS u, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'none' END AS i FROM part"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "part").selectExpr(
        "p_partkey AS id", "cast(p_partkey % 101 AS double) AS t", "cast(greatest(0L, p_partkey % 101 - p_size) AS double) AS s", "p_partkey % 17 AS n",
        "p_partkey % 5 = 0 AS c", "p_partkey % 7 = 0 AS d", "p_partkey % 3 = 0 AS u", "CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'none' END AS i",
    )


@_query("d1_status", f"SELECT id, {_STATUS} AS status FROM ({_CASES})")
def d1(spark, d):
    c = F.col
    state = decide.status(c("t"), c("s"), F.round(c("t") - c("s"), 4), c("u"), c("d"), c("n"), c("i"), F.lit(False), c("c"))
    return _cases(spark, d).select("id", state.alias("status"))


@_query("d3_cap", f"SELECT id, round(CASE WHEN d OR i = 'partial' THEN least(t, 86) ELSE t END, 2) AS value FROM ({_CASES})")
def d3(spark, d):
    return _cases(spark, d).select("id", F.round(decide.capped(F.col("t"), F.when(F.col("i") == "partial", "REVIEW_REQUIRED").otherwise("EXACT_MATCH"), F.col("d")), 2).alias("value"))


@_query("d15_levels", f"SELECT id, CASE WHEN t >= 99.5 THEN 'exact' WHEN t >= 70 THEN 'strong' WHEN t >= 40 THEN 'partial' ELSE 'none' END AS level FROM ({_CASES})")
def d15(spark, d):
    return _cases(spark, d).select("id", decide.level(F.col("t")).alias("level"))


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "part").selectExpr("p_partkey % 97 AS line_id", "p_partkey AS product_id", "cast(p_partkey AS string) AS product_code", "cast(p_size AS double) AS score", "CASE WHEN p_partkey % 31 = 0 THEN 'partial' ELSE 'none' END AS ident_type")


@_query("k1_rank", "SELECT p_partkey % 97 AS line_id, p_partkey AS product_id, row_number() OVER (PARTITION BY p_partkey % 97 ORDER BY CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE 1 END, p_size DESC, cast(p_partkey AS string), p_partkey) AS rank FROM part")
def k1(spark, d):
    return decide.ranked(_ranking(spark, d)).select("line_id", "product_id", "rank")


@_query("k3_gap", "SELECT p_partkey % 97 AS line_id, count(*) AS scored, cast(max(p_size) AS double) AS top_score, cast(list_sort(list(p_size), 'DESC')[2] AS double) AS second_score, cast(max(p_size) - list_sort(list(p_size), 'DESC')[2] AS double) AS score_gap FROM part GROUP BY 1")
def k3(spark, d):
    return decide.gaps(_ranking(spark, d))


# --- the whole match
@_query("m1_match_lines")
def m1(spark, d):
    return match_lines(A.lines(spark, d), A.catalog(spark, d), A.sales(spark, d)).select("line_id", "status", "matched_part", "percentage", "candidate_count", "route", "headline", F.array_join("reasons", "; ").alias("reasons"))


from . import queries_parts, queries_results, queries_rules, queries_sources  # noqa: E402, F401  (register further queries)

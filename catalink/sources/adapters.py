"""Catalog, sales and request lines from the driver's tables.

The expressions are plain SQL that Spark and DuckDB read alike, so that oracles can start from the same
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.stages import spread

CODE = "concat('P', lpad(cast(p_partkey AS string), 6, '0'), '-', substr(p_type, 1, 2))"
CATALOG = {
    "id": "p_partkey",
    "productcode": "cast(p_partkey AS string)",
    "name": f"CASE WHEN p_partkey % 50 = 0 THEN '-' ELSE {CODE} END",
    "description": "upper(concat(cast(p_size AS string), '\" ', p_name, ' ', p_type))",
    "description2": "concat(p_brand, ' ', p_name, ' ', cast(p_size AS string), ' IN')",
    "external_id": f"concat('NA1-', {CODE})",
    "record_type": "CASE WHEN p_partkey % 97 = 0 THEN 'Family' ELSE 'product' END",
    "orderablepartnumber": "CASE WHEN p_partkey % 9 = 0 THEN concat('ORD-', cast(p_partkey AS string)) END",
    "preferredflag": "CASE WHEN p_partkey % 4 = 0 THEN ' Preferred' ELSE 'Not Preferred' END",
}
#: One request line per part, in ten kinds.
LINES = {
    "line_id": "p_partkey",
    "source_file": "concat('quote', cast(p_partkey % 7 AS string), '.xlsx')",
    "source_sheet": "'Sheet1'",
    "source_row": "p_partkey + 2",
    "requested_description": f"""CASE p_partkey % 10
        WHEN 0 THEN {CODE} WHEN 1 THEN concat('NA1-', {CODE}) WHEN 2 THEN concat({CODE}, ' ', p_name)
        WHEN 3 THEN concat('Please quote 10 pieces of ', cast(p_size AS string), '" ', p_name, ' ', p_type)
        WHEN 4 THEN concat('Qty 12 ', upper(p_name), ' ', p_type) WHEN 5 THEN concat('3/4" ', p_name, ' ', p_type, ' 120 volts')
        WHEN 6 THEN concat(cast(p_size + 1 AS string), '" ', p_name, ' ', p_type) WHEN 7 THEN concat('PURPLE BANANA ', p_brand)
        WHEN 8 THEN concat('Ring Tray: ', cast(p_size AS string), '" ', p_name, ' LONG') ELSE concat(p_name, ' ', p_type) END""",
    "quantity": "CASE WHEN p_partkey % 3 = 0 THEN cast(p_partkey % 40 AS double) END",
    "customer_name": "CASE p_partkey % 4 WHEN 0 THEN cast(p_partkey % 200 AS string) WHEN 1 THEN cast(p_partkey % 25 AS string) WHEN 2 THEN concat('building*nation_', cast(p_partkey % 25 AS string)) END",
}
SALES = """
    SELECT o_custkey AS shipto, c_nationkey AS billto, concat(c_mktsegment, '*', n_name) AS billtoname,
           concat(coalesce(orderablepartnumber, name), '   ') AS itemnumber,
           cast(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS bigint) AS orderquantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN catalog ON l_partkey = id WHERE name <> '-'
"""


def _select(fields: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in fields.items()]


def cte(*names: str) -> str:
    """WITH clause that gives DuckDB the named views."""
    sql = {
        "catalog": f"SELECT {', '.join(_select(CATALOG))} FROM part",
        "lines": f"SELECT {', '.join(_select(LINES))} FROM part",
        "products": "SELECT * FROM catalog WHERE trim(coalesce(name, '')) NOT IN ('', '-') AND lower(trim(record_type)) = 'product'",
        "sales": SALES,
    }
    needed = [n for n in sql if n in names or n == "catalog" and {"products", "sales"} & set(names)]
    return "WITH " + ", ".join(f"{n} AS ({sql[n]})" for n in needed)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*_select(CATALOG))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "part")).selectExpr(*_select(LINES))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by customer and item: joins that Catalyst orders, with only the columns they need."""
    items = catalog(spark, sf_dir).where("name <> '-'").selectExpr("id", "concat(coalesce(orderablepartnumber, name), '   ') AS itemnumber")
    ordered = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey", "cast(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS bigint) AS orderquantity")
    nations = read(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
    customers = read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey", "c_mktsegment").join(nations, "c_nationkey")
    placed = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS c_custkey").join(customers, "c_custkey")
    return ordered.join(placed, "l_orderkey").join(items.withColumnRenamed("id", "l_partkey"), "l_partkey").selectExpr("c_custkey AS shipto", "c_nationkey AS billto", "concat(c_mktsegment, '*', n_name) AS billtoname", "itemnumber", "orderquantity")

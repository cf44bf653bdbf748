"""Queries of the relational reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranking, relational
from .common import table


def order_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON01: orders with customer, nation as second party, and the number of lines."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"))
    out = relational.with_dimension(orders, table(spark, sf_dir, "customer"), "customer_id", "c_custkey", {"c_name": "customer", "c_nationkey": "nation_id"})
    out = relational.with_dimension(out, table(spark, sf_dir, "nation"), "nation_id", "n_nationkey", {"n_name": "nation"})
    return relational.with_counts(out, table(spark, sf_dir, "lineitem"), "order_id", "l_orderkey", "n_marks").select("order_id", "customer", "nation", "status", "n_marks")


def order_detail_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON02 JON05 JON06 JON08: each order with its lines in order, as one string."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"))
    nest = relational.nested(lines, "order_id", ["n", "part"], [], "lines")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))
    joined = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["n"].cast("string"), x["part"].cast("string"))), ",")
    return orders.join(nest, "order_id", "left").select("order_id", "status", F.coalesce(joined, F.lit("")).alias("lines"))


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON03 FLT18: the 50 newest orders with the customer's name."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    newest = o.orderBy(F.desc("day"), F.desc("order_id")).limit(50)
    return relational.with_dimension(newest, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", {"c_name": "customer"}).select("order_id", "customer", "day")


def price_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT01 FLT02 FLT05: parts of a category with a substring in name or brand."""
    return relational.search(table(spark, sf_dir, "part"), ["p_name", "p_brand"], "Bolt", p_type="PROMO").select("p_partkey", "p_name", "p_brand")


def org_token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT03: customers whose joined columns hold every word."""
    c = relational.with_dimension(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", {"n_name": "nation"})
    return relational.token_search(c, ["c_name", "c_mktsegment", "nation"], "machinery nation_1 customer").select("c_custkey", "c_name", "nation")


def supplier_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON04 JON07 FLT09: items joined to their documents of one kind, counted."""
    items = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    docs = table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    return items.join(docs, items["l_suppkey"] == docs["s_suppkey"]).groupBy("s_suppkey", "s_name").agg(F.count("*").alias("n_items"), F.countDistinct("l_partkey").alias("n_parts"))


def events_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT07 FLT10 FLT12: the newest 100 events of a type."""
    return relational.search(table(spark, sf_dir, "events"), [], None, [F.desc("ts"), F.desc("event_id")], 100, event_type="error").select("event_id", "user_id", "value")


def org_latest_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT16: the newest order of each customer and status."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate")
    return ranking.first_per_key(o, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


def chosen_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT15 FLT17: orders by a set of ids, which come from another table."""
    ids = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


def usage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON20: how often each part is used and whether it may be deleted."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"))
    lines = table(spark, sf_dir, "lineitem")
    return relational.in_use(parts, "part_id", {"n_returned": (lines.filter("l_returnflag = 'R'"), "l_partkey"), "n_open": (lines.filter("l_linestatus = 'O'"), "l_partkey")})


def name_method_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON11: the first part of every name, looked up by name without case."""
    parts = table(spark, sf_dir, "part").select(F.lower(F.trim("p_name")).alias("name"), "p_partkey", "p_brand")
    first = ranking.first_per_key(parts, ["name"], [F.asc("p_partkey")])
    return parts.groupBy("name").agg(F.count("*").alias("n")).join(first, "name").select("name", "n", F.col("p_partkey").alias("first_id"), F.col("p_brand").alias("method"))


def criteria_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG06 AGG07 SNK09: names of an order's parts, joined, and the first three with how many follow."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("order_id"), F.col("p_name").alias("name"))
    names = lines.groupBy("order_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return names.select("order_id", F.array_join("names", "; ").alias("criteria"), text.summary(F.col("names")).alias("summary"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG04 AGG05: rows of every table."""
    out = None
    for name in ("customer", "documents", "events", "lineitem", "orders", "part", "supplier"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (order_list_counts, order_detail_nested, newest_orders, price_search, org_token_search, supplier_items, events_filter, org_latest_by_name, chosen_orders, usage_check, name_method_join, criteria_strings, table_counts)}
SQL = {
    "order_list_counts": """SELECT o_orderkey AS order_id, c_name AS customer, n_name AS nation, o_orderstatus AS status, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_marks
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "order_detail_nested": """SELECT o_orderkey AS order_id, o_orderstatus AS status, coalesce(l.lines, '') AS lines FROM orders LEFT JOIN
  (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""",
    "newest_orders": "SELECT o_orderkey AS order_id, c_name AS customer, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY day DESC, order_id DESC LIMIT 50",
    "price_search": "SELECT p_partkey, p_name, p_brand FROM part WHERE p_type = 'PROMO' AND (lower(p_name) LIKE '%bolt%' OR lower(p_brand) LIKE '%bolt%')",
    "org_token_search": "SELECT c_custkey, c_name, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(c_name || ' ' || c_mktsegment || ' ' || n_name) LIKE '%machinery%' AND lower(n_name) LIKE '%nation_1%'",
    "supplier_items": "SELECT s_suppkey, s_name, count(*) AS n_items, count(DISTINCT l_partkey) AS n_parts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND s_acctbal > 0 GROUP BY ALL",
    "events_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100",
    "org_latest_by_name": "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "chosen_orders": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)",
    "usage_check": """SELECT p_partkey AS part_id, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open,
  count(*) FILTER (WHERE l_returnflag = 'R') = 0 AND count(*) FILTER (WHERE l_linestatus = 'O') = 0 AS deletable
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""",
    "name_method_join": "SELECT lower(trim(p_name)) AS name, count(*) AS n, min(p_partkey) AS first_id, arg_min(p_brand, p_partkey) AS method FROM part GROUP BY 1",
    "criteria_strings": """WITH n AS (SELECT l_orderkey AS order_id, list_sort(list(DISTINCT p_name)) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
  SELECT order_id, array_to_string(names, '; ') AS criteria, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' and ' || (len(names) - 3) || ' more' ELSE '' END AS summary FROM n""",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")),
}

"""Queries of the pricing rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import marks
from ..functions.money import FINE, MONEY, format_money, money
from ..operators import cost, merge, relational
from .common import plain, spread, sql_doubles, table

MINIMUM, MARKUP, DISCOUNT = 15_000, 5, 3
HOURS, PER_HOUR = 24, "1.50"
PART_RULES = {"PROMO": "time_based", "ECONOMY": "per_core", "SMALL": "per_group", "LARGE": "prepared"}


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a price list: code, base price, rule, cores and groups."""
    part = table(spark, sf_dir, "part")
    rule = F.lit("fixed")
    for kind, name in PART_RULES.items():
        rule = F.when(F.col("p_type") == kind, name).otherwise(rule)
    return part.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), money(F.col("p_retailprice")).alias("base"), rule.alias("rule"), (F.col("p_size") % 12 + 1).alias("cores"), (F.col("p_size") % 3 + 1).alias("groups"), F.when(F.col("p_size") > 25, 1.5).otherwise(1.0).alias("factor"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of every (order, part), repeats merged to a quantity."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("code"))
    tests = spread(lines, lines.count(), "order_id", "code", each=1 << 19).groupBy("order_id", "code").agg(F.count("*").alias("quantity"))
    priced = tests.join(catalogue(spark, sf_dir), "code")
    c = F.col
    final = cost.line_cost(c("rule"), c("base"), c("quantity"), c("cores"), c("groups"), F.lit(None).cast("double"), F.lit(PER_HOUR).cast(FINE), F.lit(HOURS), c("factor"))
    return priced.select("order_id", "code", "rule", "quantity", final.alias("final_cost"))


def order_cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CST01 CST02 JON01 AGG22: totals of every order with its customer."""
    totals = cost.order_totals(order_lines(spark, sf_dir), "order_id", "final_cost", MINIMUM, MARKUP, DISCOUNT)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    named = relational.with_dimension(orders.join(totals, "order_id"), table(spark, sf_dir, "customer"), "customer_id", "c_custkey", {"c_name": "customer"})
    return named.select("order_id", "customer", "n_lines", "subtotal", "top_up", "total_net", "total_gross")


_CASES = " ".join(f"WHEN p_type = '{k}' THEN '{v}'" for k, v in PART_RULES.items())
LINES_SQL = f"""
cat AS (SELECT p_partkey AS code, p_type AS category, CAST(p_retailprice AS DECIMAL(18,2)) AS base, CASE {_CASES} ELSE 'fixed' END AS rule,
  p_size % 12 + 1 AS cores, p_size % 3 + 1 AS grp, CAST(CASE WHEN p_size > 25 THEN 1.5 ELSE 1 END AS DECIMAL(4,1)) AS factor FROM part),
tests AS (SELECT l_orderkey AS order_id, l_partkey AS code, count(*) AS quantity FROM lineitem GROUP BY ALL),
lines AS (SELECT order_id, code, rule, quantity, CAST(CASE rule
  WHEN 'time_based' THEN round((base + {PER_HOUR} * {HOURS}) * quantity, 2)
  WHEN 'per_core' THEN round(base * cores, 2) * quantity WHEN 'per_group' THEN round(base * grp, 2) * quantity
  WHEN 'prepared' THEN round(base * factor, 2) * quantity ELSE base * quantity END AS DECIMAL(18,2)) AS final_cost FROM tests JOIN cat USING (code))"""
_TOTALS = f"""
sums AS (SELECT order_id, CAST(sum(final_cost) AS DECIMAL(18,2)) AS subtotal, count(*) AS n_lines FROM lines GROUP BY order_id),
topped AS (SELECT *, CAST(greatest({MINIMUM} - subtotal, 0) AS DECIMAL(18,2)) AS top_up FROM sums),
net AS (SELECT *, CAST(CAST(CAST((subtotal + top_up) * CAST({1 + MARKUP / 100} AS DECIMAL(4,2)) AS DECIMAL(18,4)) * CAST({1 - DISCOUNT / 100} AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS DECIMAL(18,2)) AS total_net FROM topped)"""


def line_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CST01: number, quantity and cost of lines by rule."""
    lines = order_lines(spark, sf_dir)
    return lines.groupBy("rule").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.sum("final_cost").cast(MONEY).alias("cost"))


def quantity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG01: repeats of a part in an order against explicit quantities (those over 48 stand for explicit ones)."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").cast("string").alias("code"), "l_quantity")
    explicit = items.filter("l_quantity > 48").select("order_id", "code", F.col("l_quantity").cast("long").alias("quantity"))
    return cost.quantities(items, explicit, ["order_id", "code"])


def unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON10: lines whose part the catalogue (here without every tenth part) lacks."""
    known = catalogue(spark, sf_dir).filter("code % 10 <> 3")
    return cost.unknown_codes(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("code")), known, "code")


ORDER = ["PROMO", "STANDARD", "SMALL"]


def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CST08: prices per category in a fixed order of categories."""
    c = catalogue(spark, sf_dir)
    return c.groupBy("category").agg(F.count("*").alias("n"), F.sum("base").cast(MONEY).alias("base")).withColumn("position", cost.category_position(F.col("category"), ORDER))


#: Names, categories and codes of tests, twelve shapes in turn: SQL over part.
_SHAPES = [
    ("Сопротивление изоляции жил", "Электрические параметры НЧ", None), ("Сопротивление связи", "Электрические параметры ВЧ", None), ("Затухание экранирования", None, None),
    ("Емкость пары", None, None), ("Волновое сопротивление", None, None), ("Стойкость к повышенной влажности воздуха", None, None), ("Выдержка при солнечной радиации", "Внешние воздействующие факторы", None),
    ("Затухание оптического волокна", None, None), ("Сопротивление", None, "измерение_сопротивления_связи"), ("Сопротивление излучению", None, None), ("Масса", None, None), ("К солнечной радиации", "Внешние воздействующие факторы", None),
]
_SHAPE = lambda i: "CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{s[i]}'" for k, s in enumerate(_SHAPES) if s[i]) + " END"
TESTS = f"SELECT p_partkey, {_SHAPE(0)} || ', ' || p_name AS name, {_SHAPE(1)} AS category, {_SHAPE(2)} AS code, p_size FROM part"


def rule_type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CST03 CST06 CST10: how the tests of a whole catalogue are charged, by their names, with the label shown for it."""
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SHAPE(0)} || ', ' || p_name AS name", f"{_SHAPE(1)} AS category", f"{_SHAPE(2)} AS code")
    rows = df.withColumn("rule_type", cost.rule_type(F.col("name"), F.col("category"), F.col("code")))
    return rows.select("p_partkey", "rule_type", cost.rule_label(F.col("rule_type")).alias("label"))


#: Designations of samples: SQL over part.
SAMPLES = "CASE p_size % 5 WHEN 0 THEN 'ВВГнг(A)-LS ' WHEN 1 THEN 'ПУГВ ' WHEN 2 THEN 'Провод ПуГВ ' WHEN 3 THEN 'Кабель ПВБбШв ' ELSE 'пгвва ' END || (p_partkey % 19 + 1) || 'х' || p_size"


def sample_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CST04: work factor of samples, from the parts of their designations."""
    mark = F.expr(SAMPLES)
    m = marks.parse_mark(mark)
    return table(spark, sf_dir, "part").select("p_partkey", marks.complexity(mark, m["cores"], m["size"], m["has_armor"]).alias("factor"))


def proposal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG02 AGG03 SNK08: net, tax and gross of each customer's orders."""
    t = order_cost_totals(spark, sf_dir)
    s = lambda c: F.sum(c).cast(MONEY)
    return t.groupBy("customer").agg(F.count("*").alias("n_orders"), s("total_net").alias("net"), s(F.col("total_gross") - F.col("total_net")).alias("vat"), s("total_gross").alias("gross"))


def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT30: amounts as text."""
    return catalogue(spark, sf_dir).select("code", format_money(F.col("base") * 1000).alias("amount"))


def price_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG01 MRG02: new prices written over old ones; parts unknown so far are added."""
    c = catalogue(spark, sf_dir).select("code", "name", "base")
    new = c.filter("code % 7 = 0").select(F.when(F.col("code") % 14 == 0, F.col("code") + 1_000_000).otherwise(F.col("code")).alias("code"), F.upper("name").alias("name"), money(F.col("base") * 2).alias("base"))
    return merge.upsert(c, new, "code", {"name": merge.OVERWRITE, "base": merge.OVERWRITE})


def _plain(f):
    """A query whose result has no decimals."""
    return lambda spark, sf_dir: plain(f(spark, sf_dir))


QUERIES = {f.__name__: _plain(f) for f in (order_cost_totals, line_costs, quantity_merge, unknown_codes, category_order, rule_type_inference, sample_complexity, proposal_totals, money_text, price_upsert)}
SQL = {
    "order_cost_totals": f"""WITH {LINES_SQL}, {_TOTALS} SELECT order_id, c_name AS customer, n_lines, subtotal, top_up, total_net,
  CAST(round(total_net * 1.22, 2) AS DECIMAL(18,2)) AS total_gross FROM net JOIN orders ON o_orderkey = order_id LEFT JOIN customer ON c_custkey = o_custkey""",
    "line_costs": f"WITH {LINES_SQL} SELECT rule, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(final_cost) AS DECIMAL(18,2)) AS cost FROM lines GROUP BY rule",
    "quantity_merge": """SELECT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS code,
  CAST(greatest(count(*), coalesce(max(CASE WHEN l_quantity > 48 THEN CAST(l_quantity AS BIGINT) END), 0)) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL""",
    "unknown_codes": "SELECT l_partkey AS code, count(*) AS n_lines FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3) GROUP BY ALL",
    "category_order": """SELECT p_type AS category, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS base,
  CAST(CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END AS INTEGER) AS position FROM part GROUP BY p_type""",
    "rule_type_inference": f"""SELECT *, CASE rule_type WHEN 'fixed' THEN 'фикс' WHEN 'per_core' THEN '× жилы' WHEN 'per_group' THEN '× скрутка' ELSE '⏱ часы' END AS label FROM (SELECT p_partkey, CASE
  WHEN coalesce(code, '') IN ('измерение_сопротивления_связи', 'измерение_затухания_экранирования', 'измерение_затухания_излучения') THEN 'fixed'
  WHEN (lower(coalesce(category, '')) LIKE '%внешние воздействующие%' OR lower(name) LIKE 'стойкость%' OR lower(name) LIKE 'выдержка%')
   AND regexp_matches(lower(name), 'пониженной температуре|повышенной температуре|изменению температур|повышенной влажности|солнечной радиации') THEN 'time_based'
  WHEN lower(name) LIKE '%оптическ%' AND lower(name) LIKE '%волокн%' THEN 'per_core'
  WHEN (lower(name) LIKE '%сопротивлен%' AND lower(name) LIKE '%связ%') OR (lower(name) LIKE '%затухан%' AND (lower(name) LIKE '%экранир%' OR lower(name) LIKE '%излучен%')) THEN 'fixed'
  WHEN regexp_matches(lower(name), 'емкост|индуктивн|затухан|волнов') THEN 'per_group'
  WHEN lower(name) LIKE '%сопротивлен%' THEN CASE WHEN regexp_matches(lower(name), 'связи|экранирован|излучен') THEN 'per_group' ELSE 'per_core' END
  ELSE 'fixed' END AS rule_type FROM ({TESTS}))""",
    "sample_complexity": """SELECT p_partkey, CAST(CASE WHEN p_size % 5 IN (1, 2, 4) THEN 0.5 ELSE 1 END + CASE WHEN p_size % 5 = 3 THEN 0.5 ELSE 0 END
  + CASE WHEN p_partkey % 19 >= 10 THEN 0.5 ELSE 0 END + CASE WHEN p_size > 10 THEN 0.5 ELSE 0 END AS DOUBLE) AS factor FROM part""",
    "proposal_totals": f"""WITH {LINES_SQL}, {_TOTALS}, g AS (SELECT *, CAST(round(total_net * 1.22, 2) AS DECIMAL(18,2)) AS gross1 FROM net)
  SELECT c_name AS customer, count(*) AS n_orders, CAST(sum(total_net) AS DECIMAL(18,2)) AS net, CAST(sum(gross1 - total_net) AS DECIMAL(18,2)) AS vat, CAST(sum(gross1) AS DECIMAL(18,2)) AS gross
  FROM g JOIN orders ON o_orderkey = order_id LEFT JOIN customer ON c_custkey = o_custkey GROUP BY c_name""",
    "money_text": "SELECT p_partkey AS code, replace(replace(replace(format('{:,.2f}', CAST(p_retailprice AS DECIMAL(18,2)) * 1000), ',', ' '), '.', ','), '_', ' ') AS amount FROM part",
    "price_upsert": """WITH c AS (SELECT p_partkey AS code, p_name AS name, CAST(p_retailprice AS DECIMAL(18,2)) AS base FROM part),
  n AS (SELECT CASE WHEN code % 14 = 0 THEN code + 1000000 ELSE code END AS code, upper(name) AS name, CAST(base * 2 AS DECIMAL(18,2)) AS base FROM c WHERE code % 7 = 0)
  SELECT * FROM n UNION ALL SELECT * FROM c WHERE code NOT IN (SELECT code FROM n)""",
}
_DECIMALS = {"order_cost_totals": ["subtotal", "top_up", "total_net", "total_gross"], "line_costs": ["cost"], "category_order": ["base"], "proposal_totals": ["net", "vat", "gross"], "price_upsert": ["base"]}
SQL |= {name: sql_doubles(SQL[name], *columns) for name, columns in _DECIMALS.items()}

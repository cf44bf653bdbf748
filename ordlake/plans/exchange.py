"""Queries that go through files: tables are written, read back by the sources and changed, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import match, merge, ranking
from ..scratch import folder
from ..sources import files, sinks
from .common import table, values


def price_list_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC07 SRC08 SRC10 MRG01: a price list as JSON files; rows without a code are dropped; too short lists are passed over."""
    work = folder(spark)
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("base_cost"), F.col("p_type").alias("category"))
    p.write.json(f"{work}/full")
    p.limit(3).write.json(f"{work}/short")
    lists = [files.price_list(spark, f"{work}/{name}", multi_line=False) for name in ("short", "full")]
    return files.with_fallback(spark, lists, 20).select("code", "name", "base_cost", "category")


def corrections_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19 SNK16 MRG12: corrections from JSON lines read twice over; bad lines are counted apart."""
    work = folder(spark)
    e = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("doc"), F.col("event_type").alias("field"))).alias("value"))
    for part in ("a", "b"):
        e.unionByName(spark.range(3).select(F.lit("not json").alias("value"))).write.text(f"{work}/{part}")
    good, bad = files.corrections(spark, f"{work}/*")
    return good.groupBy("field").agg(F.count("*").alias("n")).unionByName(bad.agg(F.lit("(bad)").alias("field"), F.count("*").alias("n")))


#: Files of a folder tree are written by bucket of the document.
BUCKETS = 64


def folder_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC01 SRC20 SRC22 SRC23 SRC35 SRC37: files of a folder tree by kind, unknown suffixes apart, ids guessed from folders."""
    work = folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", " ").alias("value"), (F.col("doc_id") % 4).alias("group"), (F.col("doc_id") % BUCKETS).alias("bucket"))
    d.select("value", "group", "bucket").repartition(BUCKETS, "group", "bucket").write.partitionBy("group", "bucket").text(f"{work}/docs")
    d.select("value").limit(1).write.csv(f"{work}/docs/other")
    known, unknown = files.documents(spark, f"{work}/docs")
    of = lambda df, kind: df.select(kind.alias("kind"), F.coalesce(F.nullif(F.regexp_extract("path", r"group=(\d+)", 1), F.lit("")), F.lit("-")).alias("grp"))
    return of(known, F.col("kind")).unionByName(of(unknown.filter("path NOT LIKE '%/_SUCCESS' AND path NOT LIKE '%.crc'"), F.lit("?"))).groupBy("kind", "grp").agg(F.count("*").alias("n_files"))


def order_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK01 SNK02 SNK03 SNK04 SNK05 SNK06 SNK14 SNK15 SNK17 MRG15: headers and lines appended to two tables and joined again."""
    work = folder(spark)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.struct("l_partkey", "l_quantity").alias("line"))
    orders = lines.groupBy("order_id").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.count("*").alias("n"))
    sinks.order_and_lines(orders, "lines", work)
    head, body = spark.read.parquet(f"{work}/orders"), spark.read.parquet(f"{work}/lines")
    return head.join(body.groupBy("order_id").agg(F.count("*").alias("n_lines"), F.max("line_no").cast("long").alias("last"), F.sum("l_quantity").alias("quantity")), "order_id").select("order_id", "n", "n_lines", "last", "quantity")


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC25 SRC28 FLT24: snapshots as JSON, the newest twenty listed."""
    work = folder(spark)
    table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), F.col("value").alias("quality_score")).write.json(work)
    rows, _ = files.json_table(spark, work, "event_id long, label string, quality_score double", multi_line=False)
    return rows.orderBy(F.desc("event_id")).limit(20).select("event_id", "label", "quality_score")


def text_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC03 SRC29 SRC33: texts from a cache keyed by content hash and settings; what it lacks comes from the source."""
    work = folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.concat_ws("|", F.sha2("text", 256), F.lit("200"), F.lit("plain")), 256).alias("key"))
    d.filter("doc_id % 3 = 0").select("key", F.concat(F.lit("cached "), "text").alias("cached")).distinct().write.parquet(work)
    hit = d.join(spark.read.parquet(work), "key", "left")
    return hit.select("doc_id", F.col("cached").isNotNull().alias("from_cache"), F.sha2(F.coalesce("cached", "text"), 256).alias("sha256"))


def import_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC31 MRG16 MRG20: rows of an import split into valid and rejected by named reasons."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 > 0, F.col("c_name")).alias("name"), "c_acctbal")
    reasons = F.array_compact(F.array(F.when(F.col("name").isNull(), "no name"), F.when(F.col("c_acctbal") < 0, "negative balance")))
    return c.groupBy(F.coalesce(F.nullif(F.array_join(reasons, ", "), F.lit("")), F.lit("valid")).alias("verdict")).agg(F.count("*").alias("n"))


def dimension_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG07 MRG13 FLT11 FLT22 FLT25: names registered again: new titles win, kinds are kept, known names are marked."""
    old = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("old").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, "norm").alias("kind"))
    new = values(spark, [("NATION_0", "new", "x"), ("NATION_1", None, "y"), ("NATION_99", "added", "z")], "name string, title string, kind string")
    return merge.upsert(old, new, "name", {"title": merge.FILL_NEW, "kind": merge.KEEP_OLD}).withColumn("known", F.col("name").isin("NATION_0", "NATION_99")).select("name", F.coalesce("title", F.lit("-")).alias("title"), F.coalesce("kind", F.lit("-")).alias("kind"), "known")


def half_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT28: rows with a fire class and rows with a voltage of one base combined to full ones; a base has few of either."""
    p = table(spark, sf_dir, "part")
    a = p.filter("p_size % 3 = 0").selectExpr("p_brand AS base", "CASE WHEN p_size % 2 = 0 THEN 'нг(А)-LS' ELSE 'нг(А)' END AS fire").distinct()
    b = p.filter("p_size % 3 = 1").selectExpr("p_brand AS base", "CASE p_size % 4 WHEN 0 THEN '0,66' WHEN 1 THEN '1,0' ELSE '6,0' END AS voltage").distinct()
    return a.join(b, "base").select(F.concat_ws(" ", "base", "fire", "voltage").alias("mark"))


#: A text for each part that names it and its first word, and other words that only begin like names: SQL over part.
NAMED = "'Кабель ' || upper(p_name) || ', также ' || split_part(p_name, ' ', 1) || ' и ' || p_name || 'x; ' || p_brand"


def lexicon_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18 TXT26: names of a lexicon table in text, longest first and not overlapping."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.explode(F.array("p_name", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("name"))
    found = F.transform(F.regexp_extract_all(F.expr(NAMED), F.col("pattern"), F.lit(1)), F.upper)
    return p.join(match.lexicon(names, "name")).select("p_partkey", F.array_join(found, "|").alias("names"), F.size(found).cast("long").alias("n"))


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC04 ARR01 ARR02 TXT23: cells of merged columns collapsed, rows as lines, look-alike letters replaced."""
    cells = F.array(F.array("p_brand", "p_brand", "p_type"), F.array("p_name"), F.array("p_type", "p_type"))
    lines = text.table_text(F.array(F.transform(cells, text.drop_repeated_neighbours)))
    return table(spark, sf_dir, "part").select("p_partkey", lines.alias("lines"), F.translate(lines, "ABCEHKMOPTX", "АВСЕНКМОРТХ").alias("folded"))


def newest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC24 SRC34 SRC38: of several registrations of a document the one of the preferred source, then the newest."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("role") == "user", 0).otherwise(1).alias("rank"), "turn")
    return ranking.first_per_key(c, ["conv_id"], [F.asc("rank"), F.desc("turn")]).select("conv_id", F.col("rank").cast("int").alias("rank"), "turn")


QUERIES = {f.__name__: f for f in (price_list_import, corrections_import, folder_inventory, order_store, snapshot_files, text_cache, import_validation, dimension_upserts, half_rows, lexicon_marks, table_lines, newest_per_source)}
SQL = {
    "price_list_import": "SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_retailprice AS base_cost, p_type AS category FROM part WHERE p_partkey % 5 > 0",
    "corrections_import": "SELECT event_type AS field, count(DISTINCT user_id) AS n FROM events GROUP BY 1 UNION ALL SELECT '(bad)', 6",
    "folder_inventory": "SELECT 'text' AS kind, CAST(doc_id % 4 AS VARCHAR) AS grp, count(DISTINCT doc_id % 64) AS n_files FROM documents GROUP BY 2 UNION ALL SELECT 'sheet', '-', 1",
    "order_store": "SELECT l_orderkey AS order_id, count(*) AS n, count(*) AS n_lines, count(*) - 1 AS last, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
    "snapshot_files": "SELECT event_id, event_type AS label, value AS quality_score FROM events ORDER BY event_id DESC LIMIT 20",
    "text_cache": "SELECT doc_id, text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) AS from_cache, sha256(CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) THEN 'cached ' || text ELSE text END) AS sha256 FROM documents",
    "import_validation": """SELECT CASE WHEN c_custkey % 11 = 0 AND c_acctbal < 0 THEN 'no name, negative balance' WHEN c_custkey % 11 = 0 THEN 'no name' WHEN c_acctbal < 0 THEN 'negative balance' ELSE 'valid' END AS verdict, count(*) AS n FROM customer GROUP BY 1""",
    "dimension_upserts": """SELECT n_name AS name, CASE n_name WHEN 'NATION_0' THEN 'new' ELSE 'old' END AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'norm' WHEN n_name = 'NATION_1' THEN 'y' ELSE '-' END AS kind, n_name = 'NATION_0' AS known
  FROM nation UNION ALL SELECT 'NATION_99', 'added', 'z', true""",
    "half_rows": """SELECT DISTINCT a.p_brand || ' ' || CASE WHEN a.p_size % 2 = 0 THEN 'нг(А)-LS' ELSE 'нг(А)' END || ' ' || CASE b.p_size % 4 WHEN 0 THEN '0,66' WHEN 1 THEN '1,0' ELSE '6,0' END AS mark
  FROM (SELECT DISTINCT p_brand, p_size FROM part) a JOIN (SELECT DISTINCT p_brand, p_size FROM part) b ON a.p_brand = b.p_brand AND a.p_size % 3 = 0 AND b.p_size % 3 = 1""",
    "lexicon_marks": "SELECT p_partkey, upper(p_name || '|' || split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 1) || '|' || p_brand) AS names, CAST(4 AS BIGINT) AS n FROM part",
    "table_lines": """WITH t AS (SELECT p_partkey, p_brand || ' ' || p_type || chr(10) || p_name || chr(10) || p_type AS lines FROM part) SELECT p_partkey, lines, translate(lines, 'ABCEHKMOPTX', 'АВСЕНКМОРТХ') AS folded FROM t""",
    "newest_per_source": "SELECT conv_id, CAST(CASE role WHEN 'user' THEN 0 ELSE 1 END AS INTEGER) AS rank, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 0 ELSE 1 END, turn DESC) = 1",
}

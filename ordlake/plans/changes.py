"""Queries of the merge family and of streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..scratch import folder
from ..streaming import events as stream
from .common import table


def org_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG03 MRG04 MRG05 MRG09: suppliers merged into customers by key; blanks are filled, the larger balance wins."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("org_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("org_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("segment"), F.col("s_acctbal").alias("balance"))
    return merge.upsert(old, new, "org_id", {"name": merge.KEEP_OLD, "segment": merge.FILL_NEW, "balance": merge.GREATEST})


def org_merge_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG10 WIN13 JON21: customers of equal nation and segment become one; orders follow."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.concat_ws("|", "c_nationkey", "c_mktsegment"))
    merged = merge.survivors(c, "k", "c_custkey", F.col("c_acctbal") > 0)
    return merge.repoint(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", merged)


def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG08 MRG19 SRC09: names added where they are not known yet."""
    ordered = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    parts = table(spark, sf_dir, "part")
    p = lambda df: df.select(F.col("p_name").alias("pattern"), F.col("p_partkey").alias("code"))
    old = merge.latest(p(parts.join(ordered, "p_partkey", "left_semi").filter("p_type = 'PROMO'")), ["pattern"], [F.asc("code")])
    return merge.insert_or_ignore(old, p(parts), ["pattern"], [F.desc("code")])


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG02 MRG18 CLS13: given values replace stored ones."""
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = old.filter("s_suppkey % 5 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return merge.partial_update(old, new, "s_suppkey", ["s_name", "s_acctbal"])


def delta_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13 FLT19 SNK13: records since a moment, counted by type."""
    return merge.delta(table(spark, sf_dir, "events"), "ts", "2024-01-15 00:00:00").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def guarded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG11 JON20: customers asked to be deleted go unless an order refers to them."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return merge.guarded_delete(c, "c_custkey", c.filter("c_custkey % 2 = 0"), [(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"), "o_custkey")])


def feedback_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG12 JON19: entries imported once; known ones only get their new status."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"))
    old, new = e.filter("event_id < 6000"), e.filter("event_id >= 5000").withColumn("status", F.upper("status"))
    return merge.upsert(old, new, "event_id", {"status": merge.OVERWRITE})


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly counts and sums of events by type from a stream with a watermark.

    A last, later row per type closes the final windows.
    """
    work = folder(spark)
    batch = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    closing = batch.groupBy("event_type").agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts")).select("ts", "event_type", F.lit(0.0).alias("value"))
    batch.write.parquet(f"{work}/in/a")
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1000).option("recursiveFileLookup", "true").parquet(f"{work}/in")
    counts = stream.tumbling(source, "1 hour", "1 day", ["event_type"])
    stream.drain(counts, f"{work}/out", f"{work}/state")
    closing.write.parquet(f"{work}/in/b")
    stream.drain(stream.tumbling(source, "1 hour", "1 day", ["event_type"]), f"{work}/out", f"{work}/state")
    return spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{work}/out").select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: each user's first event of a type within the lateness, repeated files ignored."""
    work = folder(spark)
    batch = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    batch.unionByName(batch.filter("event_id % 2 = 0")).write.parquet(f"{work}/in")
    source = spark.readStream.schema(batch.schema).parquet(f"{work}/in")
    stream.drain(stream.distinct_within(source, ["event_id"], "60 days"), f"{work}/out", f"{work}/state")
    return spark.read.schema(batch.schema).parquet(f"{work}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


QUERIES = {f.__name__: f for f in (org_upsert, org_merge_repoint, insert_or_ignore, partial_update, delta_export, guarded_delete, feedback_import, stream_tumbling, stream_dedupe)}
SQL = {
    "org_upsert": """SELECT coalesce(c_custkey, s_suppkey * 20) AS org_id, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, s_name) AS name, c_mktsegment AS segment,
  CASE WHEN s_acctbal > c_acctbal OR c_acctbal IS NULL THEN s_acctbal ELSE c_acctbal END AS balance FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20""",
    "org_merge_repoint": """WITH k AS (SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal <= 0, c_custkey) AS keep FROM customer)
  SELECT o_orderkey, coalesce(keep, o_custkey) AS o_custkey FROM orders LEFT JOIN k ON c_custkey = o_custkey""",
    "insert_or_ignore": """WITH o AS (SELECT p_name AS pattern, min(p_partkey) AS code FROM part WHERE p_type = 'PROMO' AND p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY 1)
  SELECT * FROM o UNION ALL SELECT p_name, max(p_partkey) FROM part WHERE p_name NOT IN (SELECT pattern FROM o) GROUP BY 1""",
    "partial_update": "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "delta_export": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1",
    "guarded_delete": "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')",
    "feedback_import": "SELECT event_id, CASE WHEN event_id >= 5000 THEN upper(event_type) ELSE event_type END AS status FROM events",
    "stream_tumbling": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_dedupe": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
}

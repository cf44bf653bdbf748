"""Queries of quality measures, ranking and deduplication, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import quality, ranking
from .common import table


def _items(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select((F.col("l_orderkey") % 500).alias("doc"), (F.col("l_partkey") % 300).cast("string").alias("mark"))


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG09: expected marks (returned lines) against predicted ones (accepted lines), per document."""
    out = quality.precision_recall(_items(spark, sf_dir, "R"), _items(spark, sf_dir, "A"), "doc", "mark")
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def overall_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: macro recall, and micro recall over raw list lengths."""
    return quality.overall_recall(quality.precision_recall(_items(spark, sf_dir, "R"), _items(spark, sf_dir, "A"), "doc", "mark"))


def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13: how well a length rule predicts the quality label, per language."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    good = F.col("n_chars") >= 300
    n = lambda c: F.count_if(c).cast("long")
    return d.groupBy("lang").agg(n(good & (F.col("quality") == 1)).alias("hits"), n(good & (F.col("quality") == 0)).alias("false_hits"), n(~good & (F.col("quality") == 1)).alias("misses"))


def cer_against_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: character error of benchmark items whose vowels were lost."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.round(text.character_error_rate(F.translate("text", "aeiou", ""), F.col("text")), 6).alias("cer"))


def snapshot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: items of two runs compared per key."""
    return quality.compare(_items(spark, sf_dir, "A"), _items(spark, sf_dir, "N"), "doc", "mark")


def snapshot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14 CLS12: capped score of what was found in each document."""
    d = table(spark, sf_dir, "documents")
    lines = F.size(F.array_distinct(F.split("text", "\n")))
    garbled = F.contains("text", F.lit("***"))
    s = quality.snapshot_score(F.col("n_chars"), lines, F.col("doc_id") % 7, F.col("lang") == "en", F.col("source") == "src0", F.col("doc_id") % 4, F.col("doc_id") % 2, garbled)
    return d.select("doc_id", s.alias("quality_score"), quality.winner(s, F.lit(0.6)).alias("winner"))


def latest_version_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG08: turns of a role in a conversation as versions; the last is active."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    return ranking.versions(c, ["conv_id", "role"], [F.asc("turn")])


def subset_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN02: names of a brand that are no prefix of another name of it."""
    p = table(spark, sf_dir, "part")
    names = p.select("p_brand", "p_name").unionByName(p.select("p_brand", F.split("p_name", " ")[0].alias("p_name")))
    return ranking.drop_prefixes(names, "p_brand", "p_name")


def richer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN03: turns of a conversation merged to the longest text and the first user turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.when(F.col("role") == "user", F.col("turn")).alias("user_turn"))
    return ranking.richer(c, "conv_id", "text", "turn", ["user_turn"]).select("conv_id", F.sha2("text", 256).alias("sha256"), "user_turn")


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN01 WIN11: the first event of each user and type."""
    return ranking.first_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: the commonest priority of each customer."""
    return ranking.most_frequent(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


def filled_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: lines without a reference take the commonest one of their supplier; how many lines have each."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 3 > 0, F.concat("l_returnflag", (F.col("l_partkey") % 4).cast("string"))).otherwise("").alias("reference"))
    return ranking.fill_gaps(lines, "l_suppkey", "reference", F.col("reference") == "").groupBy("l_suppkey", "reference").agg(F.count("*").alias("n"))


def dup_hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21 SRC27: contents by hash, with how many documents share them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def recent_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12: an item moved to the front of a short list."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    items = F.array(F.lit("red bolt"), F.lit("blue gear"), F.lit("old bolt"), F.lit("hot gear"), F.lit("small ring"))
    return p.select("p_partkey", F.array_join(ranking.move_to_front(items, F.col("p_name")), "|").alias("paths"))


QUERIES = {f.__name__: f for f in (precision_recall, overall_recall, label_quality, cer_against_benchmark, snapshot_compare, snapshot_score, latest_version_active, subset_drop, richer_merge, first_per_key, most_frequent, filled_references, dup_hash_files, recent_paths)}
_I = "(SELECT l_orderkey % 500 AS doc, CAST(l_partkey % 300 AS VARCHAR) AS mark FROM lineitem WHERE l_returnflag = '{}')"
_PR = f"""e AS (SELECT doc, count(*) AS n_raw, list(DISTINCT mark) AS e FROM {_I.format('R')} GROUP BY doc), p AS (SELECT doc, list(DISTINCT mark) AS p FROM {_I.format('A')} GROUP BY doc),
  r AS (SELECT doc, coalesce(n_raw, 0) AS n_raw, coalesce(len(e), 0) AS n_expected, coalesce(len(p), 0) AS n_predicted, coalesce(len(list_intersect(e, p)), 0) AS n_matched FROM e FULL JOIN p USING (doc))"""
_C = "coalesce({0}, 0)"
SQL = {
    "precision_recall": f"WITH {_PR} SELECT *, CASE WHEN n_predicted > 0 THEN round(n_matched / n_predicted, 6) END AS precision, CASE WHEN n_expected > 0 THEN round(n_matched / n_expected, 6) END AS recall FROM r",
    "overall_recall": f"WITH {_PR} SELECT count(*) AS n_keys, round(avg(CASE WHEN n_expected > 0 THEN n_matched / n_expected END), 6) AS macro_recall, round(sum(n_matched) / sum(n_raw), 6) AS micro_recall FROM r",
    "label_quality": """SELECT lang, count(*) FILTER (WHERE n_chars >= 300 AND quality = 1) AS hits, count(*) FILTER (WHERE n_chars >= 300 AND quality = 0) AS false_hits,
  count(*) FILTER (WHERE n_chars < 300 AND quality = 1) AS misses FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
    "cer_against_benchmark": """WITH b AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(regexp_replace(text, '[aeiou]', '', 'g'), '\\s+', ' ', 'g')) AS p FROM benchmark)
  SELECT item_id, CASE WHEN t = '' THEN NULL WHEN p = '' THEN 1.0 ELSE round(levenshtein(p, t) / length(t), 6) END AS cer FROM b""",
    "snapshot_compare": f"""WITH a AS (SELECT DISTINCT doc, mark FROM {_I.format('A')}), b AS (SELECT DISTINCT doc, mark FROM {_I.format('N')}),
  o AS (SELECT coalesce(a.doc, b.doc) AS doc, count(a.mark) AS n_a, count(b.mark) AS n_b, count(*) FILTER (WHERE a.mark IS NOT NULL AND b.mark IS NOT NULL) AS n_both FROM a FULL JOIN b ON a.doc = b.doc AND a.mark = b.mark GROUP BY 1)
  SELECT doc, n_a, n_b, n_both, n_a - n_both AS only_a, n_b - n_both AS only_b, round(n_both / (n_a + n_b - n_both), 4) AS jaccard,
  CASE WHEN n_b > 0 THEN round(n_both / n_b, 4) END AS recall_a_vs_b, CASE WHEN n_a > 0 THEN round(n_both / n_a, 4) END AS recall_b_vs_a FROM o""",
    "snapshot_score": """WITH s AS (SELECT doc_id, text, CASE WHEN n_chars > 100 THEN 0.2 ELSE 0 END + CASE WHEN n_chars > 1000 THEN 0.1 ELSE 0 END + least(0.35, 0.05 * len(list_distinct(string_split(text, chr(10)))))
  + least(0.15, 0.03 * (doc_id % 7)) + CASE WHEN lang = 'en' THEN 0.1 ELSE 0 END + CASE WHEN source = 'src0' THEN 0.05 ELSE 0 END + least(0.1, 0.03 * (doc_id % 4)) + CASE WHEN doc_id % 2 > 0 THEN 0.05 ELSE 0 END AS v FROM documents),
  q AS (SELECT doc_id, CAST(round(CAST(least(CASE WHEN contains(text, '***') THEN least(v, 0.85) ELSE v END, 1) AS DECIMAL(12,6)), 3) AS DOUBLE) AS quality_score FROM s)
  SELECT doc_id, quality_score, CASE WHEN 0.6 > quality_score + CAST(0.02 AS DOUBLE) THEN 'B' WHEN quality_score > CAST(0.6 AS DOUBLE) + CAST(0.02 AS DOUBLE) THEN 'A' ELSE 'tie' END AS winner FROM q""",
    "latest_version_active": "SELECT conv_id, role, turn, row_number() OVER w AS label_version, row_number() OVER w = count(*) OVER (PARTITION BY conv_id, role) AS is_active FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)",
    "subset_drop": """WITH n AS (SELECT DISTINCT p_brand, p_name FROM part UNION SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) FROM part)
  SELECT p_brand, p_name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.p_brand = a.p_brand AND b.p_name <> a.p_name AND starts_with(b.p_name, a.p_name))""",
    "richer_merge": "SELECT conv_id, sha256(arg_max(text, (length(text), -turn))) AS sha256, min(turn) FILTER (WHERE role = 'user') AS user_turn FROM conversations GROUP BY conv_id",
    "first_per_key": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "most_frequent": "SELECT o_custkey, n, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1",
    "filled_references": """WITH l AS (SELECT l_suppkey, CASE WHEN l_partkey % 3 > 0 THEN l_returnflag || (l_partkey % 4) END AS r FROM lineitem),
  b AS (SELECT l_suppkey, r AS best FROM (SELECT l_suppkey, r, count(*) AS n FROM l WHERE r IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, r) = 1)
  SELECT l_suppkey, coalesce(r, best) AS reference, count(*) AS n FROM l LEFT JOIN b USING (l_suppkey) GROUP BY ALL""",
    "dup_hash_files": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "recent_paths": "SELECT p_partkey, array_to_string((list_prepend(p_name, list_filter(['red bolt', 'blue gear', 'old bolt', 'hot gear', 'small ring'], lambda x: x <> p_name)))[1:5], '|') AS paths FROM part",
}

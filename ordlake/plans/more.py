"""Queries of smaller operators: settings, reports, JSON payloads, adjacency, outcomes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import journal, merge, quality, ranking
from ..scratch import folder
from ..sources import files
from .common import table, values
from .pricing import LINES_SQL, order_lines


def default_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20 ARR10 MRG17: hours of time-based tests from settings, else from the catalogue; one value per key."""
    settings = values(spark, [("PROMO", 8.0), ("SMALL", 0.0)], "key string, hours double").withColumn("rank", F.lit(0)).filter("hours > 0")
    catalogue = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("key")).agg(F.max("p_size").cast("double").alias("hours")).withColumn("rank", F.lit(1))
    return ranking.first_per_key(settings.unionByName(catalogue), ["key"], [F.asc("rank")]).select("key", "hours")


def breakdown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CST09 AGG25 JON09 SNK18: the lines of an order as text."""
    line = F.format_string("%d x%d %s", "code", "quantity", F.col("final_cost").cast("string"))
    lines = order_lines(spark, sf_dir).withColumn("line", line)
    return lines.groupBy("order_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "; ").alias("breakdown"))


def catalogue_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CST05 CST07: aliases of codes replaced, deprecated codes removed, equal codes merged."""
    parts = table(spark, sf_dir, "part").select("p_type", "p_retailprice")
    alias = values(spark, [("PROMO", "LARGE"), ("ECONOMY", "SMALL")], "p_type string, code string")
    gone = values(spark, [("STANDARD",)], "p_type string")
    kept = parts.join(F.broadcast(gone), "p_type", "left_anti").join(F.broadcast(alias), "p_type", "left")
    return kept.groupBy(F.coalesce("code", "p_type").alias("code")).agg(F.count("*").alias("n"), F.max("p_retailprice").alias("price"))


def used_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT06 FLT14 FLT23 AGG21: parts used at least 40 times, by use and name."""
    use = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("usage"))
    return use.filter("usage >= 40").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").orderBy(F.desc("usage"), "p_name", "p_partkey")


#: Labels that name their document in five ways: SQL over labels and documents.
LABELS = {
    "label_id": "doc_id", "document_id": "CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id AS STRING) WHEN doc_id % 2 = 0 THEN '-' ELSE '999999999999' END",
    "source_file": "CASE doc_id % 5 WHEN 1 THEN 'scans/' || doc_id || '_' || lang || '.TXT' WHEN 3 THEN '_' || lang || '.txt' WHEN 4 THEN 'nothing.pdf' END",
    "label_file": "CASE doc_id % 5 WHEN 2 THEN 'labels/' || doc_id || '_' || lang || '.txt.json' ELSE 'labels/none.json' END",
}


def label_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON18: the document of each label by id, else by file name, else by the end of a path, the newest one, with the way it was found."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id").join(d, "doc_id").select(*[F.expr(sql).alias(c) for c, sql in LABELS.items()])
    paths = d.select(F.col("doc_id").alias("document_id"), F.expr("'in/' || source || '/' || doc_id || '_' || lang || '.txt'").alias("path"))
    return journal.resolve_labels(labels, paths)


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: two extraction runs of each part's orders compared by measures; the winner by quality, within a margin."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("marks"), F.count_if(F.col("l_discount") > 0.05).alias("documents"), F.max("l_linenumber").alias("tables"))
    run = lambda marks, chars: lines.select("p_partkey", marks.cast("long").alias("marks"), chars.cast("long").alias("chars"), quality.snapshot_score(chars, marks, F.col("documents"), F.col("tables") > 5, F.col("tables") > 6, F.lit(2), F.col("tables"), F.col("p_partkey") % 5 == 0).alias("quality"))
    a, b = run(F.col("marks"), F.col("marks") * 30), run(F.greatest(F.col("marks") - F.col("p_partkey") % 40, F.lit(0)), F.col("marks") * 40)
    return quality.compare_runs(a.filter("p_partkey % 11 > 0"), b.filter("p_partkey % 13 > 0"), "p_partkey", ["marks", "chars"], "quality")


def benchmark_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13 SNK15: documents of each language, done and failed, and those that clean-up made better; the report is written as JSON and read back."""
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id") % 17 == 0, F.col("doc_id") % 3 > 0, F.col("doc_id"), F.col("n_chars")).toDF("lang", "failed", "known", "doc_id", "n_chars")
    rate = lambda m: F.when(F.col("known"), (F.col("n_chars") % m) / m)
    sure = lambda m: F.when(F.col("doc_id") % 7 > 0, (F.col("n_chars") % m).cast("double"))
    out = quality.batch(d, ["lang"], F.col("failed"), rate(10), rate(8), sure(9), sure(11))
    work = folder(spark)
    out.write.json(work)
    return spark.read.schema(out.schema).json(work)


#: Extraction payloads of parts: marks as text, as objects, both, none, and broken JSON: SQL over part.
PAYLOADS = """CASE p_size % 5 WHEN 0 THEN '{"marks_expected": ["' || p_name || '", {"mark": "' || p_brand || '"}]}' WHEN 1 THEN '{"marks_expected": [{"mark": "' || p_brand || '", "n": 2}]}'
  WHEN 2 THEN '{"marks_expected": ["' || p_name || '", "' || p_type || '"]}' WHEN 3 THEN '{"pages": []}' ELSE '{"marks_expected": ["' || p_name END"""


def expected_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR06: marks of a list whose elements are strings or objects; nothing for other payloads."""
    raw = F.from_json(F.get_json_object(F.expr(PAYLOADS), "$.marks_expected"), "array<string>")
    marks = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.coalesce(F.get_json_object(x, "$.mark"), x))
    return table(spark, sf_dir, "part").select("p_partkey", marks.alias("m")).select("p_partkey", F.array_join("m", "|").alias("marks"), F.size("m").cast("long").alias("n_marks"))


def adjacent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR09 WIN04: neighbouring events of one type and user merged to runs."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    new = F.when(F.lag("event_type").over(w) == F.col("event_type"), 0).otherwise(1)
    runs = e.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n", "first_id")


def correction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG24 TXT32: corrected names against expected ones: yes, partial or no, counted per brand."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_name", F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.split("p_name", " ")[0]).otherwise("?").alias("got"))
    same = text.mark_key(F.col("got")) == text.mark_key(F.col("p_name"))
    outcome = F.when(same, "yes").when(F.startswith(text.mark_key(F.col("p_name")), text.mark_key(F.col("got"))), "partial").otherwise("no")
    return p.groupBy("p_brand").agg(*[F.count_if(outcome == o).cast("long").alias(f"n_{o}") for o in ("yes", "partial", "no")])


def distinct_then_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10: one computation per distinct name, joined back to all rows."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    once = p.select("p_name").distinct().withColumn("key", text.mark_key(F.col("p_name")))
    return p.join(once, "p_name").select("p_partkey", "key")


def priority_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN07 WIN14: the first of a customer's orders by priority, then price, then id."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey")
    return ranking.first_per_key(o, ["o_custkey"], [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")])


def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK07 SNK11 TXT33: nested data as JSON text and read back."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    j = n.select("n_regionkey", F.to_json(F.struct(F.col("n_regionkey").alias("region"), "nations")).alias("j"))
    return j.select("n_regionkey", F.get_json_object("j", "$.nations[0]").alias("first"), F.json_array_length(F.get_json_object("j", "$.nations")).cast("long").alias("n"), F.size(files.json_map(F.col("j"))).cast("long").alias("n_fields"))


#: Cells with one or two names of tests: SQL over part.
JAMMED = "CASE p_size % 3 WHEN 0 THEN 'Проверка ' || p_name || ' Измерение ' || p_type WHEN 1 THEN 'Стойкость к ' || p_name ELSE 'Испытание ' || p_name || ' на стойкость' END"


def jammed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT09: two names in one cell, told apart by a second opening word."""
    names = text.jammed(F.expr(JAMMED))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, "|").alias("names"), F.size(names).cast("long").alias("n"))


def replace_for_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG14 MRG06: all rows of some documents replaced by new ones, the others kept."""
    old = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    new = old.filter("conv_id % 3 = 0 AND turn < 2").withColumn("role", F.upper("role"))
    kept = old.join(new.select("conv_id").distinct(), "conv_id", "left_anti")
    return kept.unionByName(merge.latest(new, ["conv_id", "turn"], [F.asc("role")]))


QUERIES = {f.__name__: f for f in (default_hours, breakdown_text, catalogue_cleanup, used_mappings, label_resolution, run_comparison, benchmark_batch, expected_marks, adjacent_runs, correction_outcomes, distinct_then_join, priority_rows, nested_json, jammed_names, replace_for_document)}
_KEY = "regexp_replace(regexp_replace(replace(lower({}), 'х', 'x'), '(\\d),(\\d)', '\\1.\\2', 'g'), '\\s+', '', 'g')"
SQL = {
    "default_hours": "SELECT p_type AS key, CAST(CASE WHEN p_type = 'PROMO' THEN 8 ELSE max(p_size) END AS DOUBLE) AS hours FROM part GROUP BY p_type",
    "breakdown_text": f"WITH {LINES_SQL} SELECT order_id, string_agg(code || ' x' || quantity || ' ' || final_cost, '; ' ORDER BY code || ' x' || quantity || ' ' || final_cost) AS breakdown FROM lines GROUP BY order_id",
    "catalogue_cleanup": "SELECT CASE p_type WHEN 'PROMO' THEN 'LARGE' WHEN 'ECONOMY' THEN 'SMALL' ELSE p_type END AS code, count(*) AS n, max(p_retailprice) AS price FROM part WHERE p_type <> 'STANDARD' GROUP BY 1",
    "used_mappings": "SELECT p_partkey, count(*) AS usage, p_name FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_partkey, p_name HAVING count(*) >= 40",
    "label_resolution": """SELECT l.doc_id AS label_id, CASE WHEN l.doc_id % 5 < 3 THEN l.doc_id WHEN l.doc_id % 5 = 3 THEN (SELECT max(x.doc_id) FROM documents x WHERE x.lang = d.lang) END AS document_id,
  (['id', 'name', 'name', 'path', NULL])[l.doc_id % 5 + 1] AS found_by FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "run_comparison": """WITH l AS (SELECT l_partkey AS p, count(*) AS m, count(*) FILTER (WHERE l_discount > 0.05) AS d, max(l_linenumber) AS t FROM lineitem GROUP BY 1),
  r AS (SELECT p, m AS ma, 30 * m AS ca, greatest(m - p % 40, 0) AS mb, 40 * m AS cb, least(150, 30 * d) + CASE WHEN t > 5 THEN 100 ELSE 0 END + CASE WHEN t > 6 THEN 50 ELSE 0 END + 60 + CASE WHEN t > 0 THEN 50 ELSE 0 END AS rest, CASE WHEN p % 5 = 0 THEN 850 ELSE 1000 END AS most FROM l),
  q AS (SELECT *, least(most, rest + least(350, 50 * ma) + CASE WHEN ca > 100 THEN 200 ELSE 0 END + CASE WHEN ca > 1000 THEN 100 ELSE 0 END) AS qa, least(most, rest + least(350, 50 * mb) + CASE WHEN cb > 100 THEN 200 ELSE 0 END + CASE WHEN cb > 1000 THEN 100 ELSE 0 END) AS qb FROM r)
  SELECT p AS p_partkey, CASE WHEN p % 11 > 0 AND p % 13 > 0 THEN mb - ma END AS delta_marks, CASE WHEN p % 11 > 0 AND p % 13 > 0 THEN cb - ca END AS delta_chars, CASE WHEN p % 11 > 0 AND p % 13 > 0 THEN round((qb - qa) / 1000, 3) END AS delta_quality,
  CASE WHEN p % 11 > 0 AND p % 13 > 0 THEN CASE WHEN qb / 1000 > qa / 1000 + 0.02::DOUBLE THEN 'B' WHEN qa / 1000 > qb / 1000 + 0.02::DOUBLE THEN 'A' ELSE 'tie' END END AS winner FROM q WHERE p % 11 > 0 OR p % 13 > 0""",
    "benchmark_batch": """SELECT lang, count(*) AS files_total, count(*) FILTER (WHERE doc_id % 17 > 0) AS files_ok, count(*) FILTER (WHERE doc_id % 17 = 0) AS files_error,
  count(*) FILTER (WHERE doc_id % 17 > 0 AND CASE WHEN doc_id % 3 > 0 THEN (n_chars % 8) * 10 < (n_chars % 10) * 8 ELSE doc_id % 7 > 0 AND n_chars % 11 > n_chars % 9 END) AS improved FROM documents GROUP BY lang""",
    "expected_marks": """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name || '|' || p_brand WHEN 1 THEN p_brand WHEN 2 THEN p_name || '|' || p_type ELSE '' END AS marks,
  CAST((['2', '1', '2', '0', '0'])[p_size % 5 + 1] AS BIGINT) AS n_marks FROM part""",
    "adjacent_runs": """WITH s AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM s) SELECT user_id, run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run""",
    "correction_outcomes": "SELECT p_brand, count(*) FILTER (WHERE p_size % 3 = 0) AS n_yes, count(*) FILTER (WHERE p_size % 3 = 1) AS n_partial, count(*) FILTER (WHERE p_size % 3 = 2) AS n_no FROM part GROUP BY p_brand",
    "distinct_then_join": f"SELECT p_partkey, {_KEY.format('p_name')} AS key FROM part",
    "priority_rows": "SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) = 1",
    "nested_json": "SELECT n_regionkey, min(n_name) AS first, count(*) AS n, CAST(2 AS BIGINT) AS n_fields FROM nation GROUP BY n_regionkey",
    "jammed_names": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Проверка ' || p_name || '|Измерение ' || p_type WHEN 1 THEN 'Стойкость к ' || p_name ELSE 'Испытание ' || p_name || ' на стойкость' END AS names,
  CAST(CASE p_size % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM part""",
    "replace_for_document": "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN upper(role) ELSE role END AS role FROM conversations c WHERE conv_id % 3 <> 0 OR turn < 2 OR NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn < 2)",
}

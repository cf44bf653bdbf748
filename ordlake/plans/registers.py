"""Queries over registers that change: merged organisations, imports that run once, packs, replaced documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..scratch import folder, save
from ..sources import packs, sinks
from ..streaming import ledger
from .common import table

_FILL = ["tax_id", "address", "phone", "email"]


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of organisations from customers and suppliers (from 1000000 on): few have a tax id, names repeat, details are blank."""

    def card(df: DataFrame, key: str, name: str, start: int) -> DataFrame:
        k = F.col(key)
        some = lambda n, of, tag: F.when(k % n == 0, F.concat(F.lit(tag), (k % of).cast("string")))
        named = F.when(k % 4 == 0, F.concat(F.lit("firm "), (k % 90).cast("string"))).when(k % 4 == 1, F.lit("")).otherwise(F.lower(name))
        return df.select((k + start).alias("org_id"), named.alias("name"), some(6, 77, "T").alias("tax_id"), some(5, 1000, "street ").alias("address"), F.when(k % 7 == 0, F.lit(" ")).otherwise(some(3, 500, "+1")).alias("phone"), some(8, 400, "m@").alias("email"))

    return card(table(spark, sf_dir, "customer"), "c_custkey", "c_name", 0).unionByName(card(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", 1_000_000))


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return merge.merge_linked(_cards(spark, sf_dir), "org_id", ["tax_id", "name"], F.trim(F.coalesce("tax_id", F.lit(""))) != "", _FILL, save)


def org_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG10 JON21 WIN13: cards with a tax id or a name in common become one, over any number of steps; blanks are filled."""
    return _merged(spark, sf_dir)[0]


def org_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG10: the five references to organisations, led to the cards that stay: how many each kind has for each card."""
    moved = save(_merged(spark, sf_dir)[1])
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    events = table(spark, sf_dir, "events")
    maker = lambda c: (F.col(c) + 1_000_000).alias("org")
    facts = {
        "order_customer": o.select(F.col("o_custkey").alias("org")),
        "order_maker": o.select((F.col("o_orderkey") % 97 + 1_000_000).alias("org")),
        "mark_maker": lines.select(maker("l_suppkey")),
        "letter_customer": events.select(F.col("user_id").alias("org")),
        "letter_maker": events.select((F.col("user_id") % 50 + 1_000_000).alias("org")),
    }
    out = None
    for kind, df in facts.items():
        own = merge.repoint(df.groupBy("org").agg(F.count("*").alias("n")), "org", moved).groupBy("org").agg(F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "org", "n")
        out = own if out is None else out.unionByName(own)
    return out


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("user "), (F.col("user_id") % 40).cast("string")).alias("title"), "props", F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("string").alias("created_at"), F.col("event_type").alias("status"), "event_id")


def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG12 SRC19 JON19: a folder of JSON lines tailed in two runs, one file in it twice: entries by (title, props, created_at),
    new ones inserted, known ones given the status of their greatest event_id."""
    work = folder(spark)
    rows = _feedback(spark, sf_dir)
    rows.filter("event_id % 2 = 0").write.json(f"{work}/in/a")
    keys, schema = ["title", "props", "created_at"], rows.schema
    run = lambda: ledger.tail_json(spark, f"{work}/in/*", schema, keys, "event_id", ["status"], f"{work}/table", f"{work}/state")
    run()
    rows.filter("event_id % 2 = 0").write.json(f"{work}/in/b")
    rows.filter("event_id % 3 <> 0").write.json(f"{work}/in/c")
    run()
    return ledger.current(spark, f"{work}/table").select(*keys, "status")


def pack_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC27 SNK13: tables exported as a pack, imported twice, then only what came later: rows by table and run of import."""
    work = folder(spark)
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = lambda until: {"clicks": e.filter((F.col("event_type") == "click") & (F.col("ts") < until)), "errors": e.filter((F.col("event_type") == "error") & (F.col("ts") < until))}
    half, end = F.lit("2024-01-15").cast("timestamp"), F.lit("2100-01-01").cast("timestamp")
    first = packs.export_pack(parts(half), "ts", f"{work}/packs", "p1", None)
    packs.export_pack(parts(end), "ts", f"{work}/packs", "p2", first)
    got = [packs.import_pack(spark, f"{work}/packs", name, f"{work}/store").withColumn("run", F.lit(i)) for i, name in enumerate(["p1", "p1", "p2"])]
    return got[0].unionByName(got[1]).unionByName(got[2]).select("table", "run", "n_new", "n_known")


def inbox_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20 SRC21 SRC22: an inbox tailed in three runs: files, then copies of them and files of unknown kinds, then nothing new."""
    work = folder(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[\r\n]", " ").alias("value"), (F.col("doc_id") % 24).alias("part"))
    lines = d.repartition(24, "part").sortWithinPartitions("part", "doc_id").select("part", "value")
    out = []
    for run in range(3):
        if run < 2:
            lines.write.partitionBy("part").text(f"{work}/inbox/{run}")
        if run == 1:
            lines.filter("part < 5").write.partitionBy("part").option("compression", "gzip").text(f"{work}/inbox/other")
        out.append((run, *ledger.ingest(spark, f"{work}/inbox", f"{work}/table", f"{work}/state").values()))
    sizes = ledger.registered(spark, f"{work}/table").agg(F.sum("size").alias("bytes"))
    runs = spark.createDataFrame(out, "run int, registered long, known long, quarantined long")
    return runs.join(F.broadcast(sizes))


def import_with_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC31 SRC35 MRG20: rows of a price list with all reasons why each is rejected; what was counted in the same pass is in every row."""
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey").cast("string")).alias("code"), F.when(F.col("p_size") % 11 > 0, F.col("p_name")).otherwise(F.lit(" ")).alias("name"), F.when(F.col("p_size") % 13 > 0, F.col("p_retailprice")).otherwise(-F.col("p_retailprice")).alias("cost"), "p_partkey")
    rules = {"no code": F.trim(F.coalesce("code", F.lit(""))) == "", "no name": F.trim(F.coalesce("name", F.lit(""))) == "", "cost not positive": ~F.coalesce(F.col("cost") > 0, F.lit(False))}
    work = folder(spark)
    dry, counts = packs.import_checked(p, rules, None), packs.import_checked(p, rules, work)
    rejected = spark.read.parquet(f"{work}/accepted=false").select("p_partkey", F.array_join("reasons", "; ").alias("reasons"))
    return rejected.select("*", F.lit(dry["n_rows"]).alias("n_rows"), F.lit(counts["n_rejected"]).alias("n_rejected"), F.lit(counts["no name"]).alias("n_without_name"))


def replace_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG14: the rows of some documents replaced in a stored table; buckets without such a document are not written again."""
    work = folder(spark)
    old = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    sinks.store_by_bucket(old, f"{work}/table", "conv_id", 16)
    new = old.filter("conv_id % 16 IN (3, 6) AND conv_id % 3 = 0 AND turn < 2").withColumn("role", F.upper("role"))
    kept = sinks.replace_documents(spark, f"{work}/table", new, "conv_id", 16)
    return spark.read.parquet(f"{work}/table").select("conv_id", "turn", "role", F.lit(kept).alias("untouched_buckets"))


QUERIES = {f.__name__: f for f in (org_merge, org_references, feedback_stream, pack_exchange, inbox_runs, import_with_rejects, replace_in_place)}

_CARD = "SELECT {k} + {start} AS org_id, CASE {k} % 4 WHEN 0 THEN 'firm ' || ({k} % 90) WHEN 1 THEN '' ELSE lower({n}) END AS name, CASE WHEN {k} % 6 = 0 THEN 'T' || ({k} % 77) END AS tax_id, CASE WHEN {k} % 5 = 0 THEN 'street ' || ({k} % 1000) END AS address, CASE WHEN {k} % 7 = 0 THEN ' ' WHEN {k} % 3 = 0 THEN '+1' || ({k} % 500) END AS phone, CASE WHEN {k} % 8 = 0 THEN 'm@' || ({k} % 400) END AS email FROM {t}"
_GROUPS = f"""WITH RECURSIVE c AS ({_CARD.format(k='c_custkey', n='c_name', start=0, t='customer')} UNION ALL {_CARD.format(k='s_suppkey', n='s_name', start=1000000, t='supplier')}),
  edge AS (SELECT DISTINCT org_id, k FROM (SELECT org_id, 't' || tax_id AS k FROM c WHERE trim(tax_id) <> '' UNION ALL SELECT org_id, 'n' || trim(name) FROM c WHERE trim(name) <> '')),
  link AS (SELECT DISTINCT a.org_id AS a, b.org_id AS b FROM (SELECT k, min(org_id) AS org_id FROM edge GROUP BY k) a JOIN edge b USING (k)),
  sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
  reach AS (SELECT org_id, org_id AS node FROM c UNION SELECT r.org_id, b.b FROM reach r JOIN sym b ON r.node = b.a),
  grp AS (SELECT org_id, min(node) AS root FROM reach GROUP BY org_id),
  g AS (SELECT c.*, root, row_number() OVER (PARTITION BY root ORDER BY trim(coalesce(tax_id, '')) = '', org_id) AS k FROM c JOIN grp USING (org_id))"""
_FIRST = "coalesce((SELECT arg_min({c}, k) FROM g h WHERE h.root = g.root AND trim({c}) <> ''), {c}) AS {c}"
SQL = {
    "org_merge": f"{_GROUPS} SELECT org_id, name, {', '.join(_FIRST.format(c=c) for c in _FILL)} FROM g WHERE k = 1",
    "org_references": f"""{_GROUPS}, f AS (SELECT 'order_customer' AS kind, o_custkey AS org FROM orders UNION ALL SELECT 'order_maker', o_orderkey % 97 + 1000000 FROM orders UNION ALL SELECT 'mark_maker', l_suppkey + 1000000 FROM lineitem
  UNION ALL SELECT 'letter_customer', user_id FROM events UNION ALL SELECT 'letter_maker', user_id % 50 + 1000000 FROM events),
  keep AS (SELECT g.org_id, h.org_id AS keep FROM g JOIN g AS h ON h.root = g.root AND h.k = 1)
  SELECT kind, coalesce(keep, org) AS org, count(*) AS n FROM f LEFT JOIN keep ON keep.org_id = f.org GROUP BY ALL""",
    "feedback_stream": """SELECT title, props, created_at, arg_max(status, event_id) AS status FROM (SELECT 'user ' || (user_id % 40) AS title, props, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS created_at, event_type AS status, event_id FROM events WHERE event_id % 2 = 0 OR event_id % 3 <> 0) GROUP BY ALL""",
    "pack_exchange": """WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'clicks' ELSE 'errors' END AS t, * EXCLUDE (event_id), event_id, ts < TIMESTAMP '2024-01-15' AS early FROM events WHERE event_type IN ('click', 'error')),
  n AS (SELECT t, count(*) FILTER (WHERE early) AS a, count(*) FILTER (WHERE NOT early) AS b FROM e GROUP BY t)
  SELECT t AS "table", 0 AS run, a AS n_new, 0::BIGINT AS n_known FROM n WHERE a > 0 UNION ALL SELECT t, 1, 0, a FROM n WHERE a > 0 UNION ALL SELECT t, 2, b, 0 FROM n WHERE b > 0""",
    "inbox_runs": """WITH n AS (SELECT count(DISTINCT doc_id % 24) AS k, count(DISTINCT CASE WHEN doc_id % 24 < 5 THEN doc_id % 24 END) AS few, sum(strlen(regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g')) + 1)::BIGINT AS bytes FROM documents)
  SELECT 0 AS run, k AS registered, 0::BIGINT AS known, 0::BIGINT AS quarantined, bytes FROM n UNION ALL SELECT 1, 0, k, few, bytes FROM n UNION ALL SELECT 2, 0, 0, 0, bytes FROM n""",
    "import_with_rejects": """WITH r AS (SELECT p_partkey, list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'no code' END, CASE WHEN p_size % 11 = 0 THEN 'no name' END, CASE WHEN NOT coalesce(CASE WHEN p_size % 13 > 0 THEN p_retailprice ELSE -p_retailprice END > 0, false) THEN 'cost not positive' END], lambda x: x IS NOT NULL) AS reasons FROM part)
  SELECT p_partkey, array_to_string(reasons, '; ') AS reasons, (SELECT count(*) FROM part) AS n_rows, (SELECT count(*) FROM r WHERE len(reasons) > 0) AS n_rejected, (SELECT count(*) FROM part WHERE p_size % 11 = 0) AS n_without_name FROM r WHERE len(reasons) > 0""",
    "replace_in_place": """SELECT conv_id, turn, CASE WHEN new THEN upper(role) ELSE role END AS role, (SELECT count(DISTINCT conv_id % 16) - count(DISTINCT CASE WHEN conv_id % 16 IN (3, 6) AND conv_id % 3 = 0 AND turn < 2 THEN conv_id % 16 END) FROM conversations)::INTEGER AS untouched_buckets FROM (SELECT *, conv_id % 16 IN (3, 6) AND conv_id % 3 = 0 AND turn < 2 AS new FROM conversations)
  WHERE new OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 16 IN (3, 6) AND conv_id % 3 = 0 AND turn < 2)""",
}

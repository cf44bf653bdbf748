"""Queries of corrected designations, synonyms, path hints, cells and organisation cards, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..operators import correct, merge
from ..operators.match import small
from ..scratch import folder
from ..sources import files
from .common import table

# SQL over part that both engines read: a clean designation of a part, and the way it was typed.
CABLE = "CASE p_size % 3 WHEN 0 THEN 'ВВГнг(А)-LS ' WHEN 1 THEN 'КПСнг(А)-FRLS ' ELSE 'КСБнг(А)-LS ' END || p_size || 'х2,5'"
TYPED = f"""CASE p_partkey % 6 WHEN 0 THEN {CABLE} WHEN 1 THEN replace(replace({CABLE}, 'В', 'B'), 'К', 'K') WHEN 2 THEN replace({CABLE}, 'LS', 'L')
  WHEN 3 THEN replace(replace(replace({CABLE}, 'LS', 'L'), 'С', 'C'), 'ВВ', 'BВ') WHEN 4 THEN 'кабель ' || p_name ELSE ' ' END"""


def mark_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT32 TXT39 WIN10: typed designations of all parts, corrected by spelling and by the catalogue's names."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(TYPED).alias("typed"), F.expr(CABLE).alias("clean"))
    out = correct.marks(p, "p_partkey", "typed", p.select("clean").distinct(), "clean")
    return out.withColumn("confidence", F.round("confidence", 4))


#: Synonyms: the first words of names, some longer, with codes that aliases lead on: SQL over part.
_FIRST = "split_part(p_name, ' ', 1)"


def synonym_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON14 TXT38 SRC15 SRC16: codes of part names by a file of synonyms, its aliases followed."""
    work = folder(spark)
    p = table(spark, sf_dir, "part")
    words = small(p.select(F.expr(_FIRST).alias("w")).distinct())
    listed = words.select(F.struct(F.concat("w", F.when(F.length("w") % 2 == 0, " ring").otherwise("")).alias("phrase"), F.concat(F.lit("C"), F.length("w")).alias("canonical_code"), F.when(F.length("w") != 4, 0.5 + F.length("w") / 100).alias("confidence")).alias("s"))
    aliases = F.create_map(F.lit("C3"), F.lit("код три"), F.lit("C5"), F.lit("код пять"))
    whole = listed.agg(F.sort_array(F.collect_list("s")).alias("synonyms")).select(F.to_json(F.struct("synonyms", aliases.alias("code_aliases"))).alias("value"))
    whole.write.text(work)
    synonyms, codes = files.synonyms(spark, work)
    texts = p.select("p_partkey", F.expr("CASE WHEN p_partkey % 10 = 0 THEN left(p_name, 3) ELSE ' ' || upper(p_name) END").alias("t"))
    found = correct.resolve_synonym(texts, "p_partkey", "t", synonyms)
    return correct.canonical_codes(found, "code", codes)


#: Paths of orders' files, with a customer's folder in several shapes: SQL over orders and customer.
PATHS = """'C:/Users/i.ivanov/' || CASE o_orderkey % 6 WHEN 0 THEN 'ООО ' || c_name || '/2026/ВВГ 3х2' WHEN 1 THEN 'Документы/' || c_mktsegment || '/' || year(o_orderdate) WHEN 2 THEN 'Каменск ' || c_name || '/inbox'
  WHEN 3 THEN 'завод ' || c_nationkey || '/SUPR/temp' WHEN 4 THEN 'Desktop/2025' ELSE 'SUPR/ЛПМФ нг(А)/Кабель ' || c_nationkey END || '/' || o_orderkey || '.pdf'"""


def customer_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT37: the customer that the folders of a request's path suggest."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", extract.customer_hint(F.expr(PATHS)).alias("hint"))


#: Cells that cite a norm and a clause in four ways: SQL over part.
CELLS = """CASE p_partkey % 5 WHEN 0 THEN 'ТУ 16.К99-0' || p_size || '–2014 (1.' || p_size || '.1)' WHEN 1 THEN 'п. 2.' || p_size || '  3.1, ТУ 3581-00' || p_size || '-2009'
  WHEN 2 THEN '1.' || p_size || '.2÷1.' || p_size || '.5; 4.1' WHEN 3 THEN 'по чертежу ' || p_name ELSE 'ТУ 27-' || p_size END"""


def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT08: norm and clause of a table's cell, and the clause's numbers."""
    r = extract.document_and_clause(F.expr(CELLS), "общий")
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.document", "r.clause", F.array_join(extract.clause_tokens(F.col("r.clause")), "|").alias("numbers"))


#: Cards: customers in twos under one name, of which the first has a tax id. SQL over customer.
CARDS = {
    "org_id": "c_custkey", "name": "'Завод ' || CAST(floor(c_custkey / 2) AS BIGINT)", "inn": "CASE WHEN c_custkey % 2 = 0 THEN CAST(7700000000 + c_custkey AS STRING) END",
    "org_type": "CASE WHEN c_nationkey % 2 = 0 THEN 'dealer' ELSE 'unknown' END", "accredited": "c_nationkey % 5 = 0", "phone": "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END",
}
#: Found organisations: by tax id, by name, new ones under shared names, and placeholders. SQL over supplier.
FOUND = {
    "position": "s_suppkey",
    "name": "CASE s_suppkey % 4 WHEN 0 THEN 'ООО \"завод ' || s_suppkey || '\"' WHEN 1 THEN 'Завод ' || s_suppkey || '.' WHEN 2 THEN 'Новый ' || (s_suppkey % 14) ELSE 'Заказчик' END",
    "inn": "CASE WHEN s_suppkey % 4 = 0 THEN CAST(7700000000 + 2 * s_suppkey AS STRING) WHEN s_suppkey % 12 = 2 THEN CAST(5000000000 + s_suppkey % 14 AS STRING) END",
    "org_type": "CASE WHEN s_nationkey % 2 = 0 THEN 'manufacturer' ELSE 'unknown' END", "accredited": "s_nationkey % 7 = 0", "phone": "CASE WHEN s_suppkey % 8 < 6 AND s_suppkey % 8 > 0 THEN s_name END",
}


def organisation_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG09 MRG20 JON21: organisations found written into cards by tax id, else by name; twins without a tax id merged."""
    rows = lambda name, columns: table(spark, sf_dir, name).select(*[F.expr(sql).alias(c) for c, sql in columns.items()])
    cards, moved = merge.upsert_organisations(rows("customer", CARDS), rows("supplier", FOUND), ["phone"])
    return cards.join(moved.groupBy(F.col("keep_id").alias("org_id")).agg(F.count("*").alias("n_merged")), "org_id", "left").fillna(0, ["n_merged"])


QUERIES = {f.__name__: f for f in (mark_corrections, synonym_codes, customer_hints, cell_references, organisation_cards)}
_SELECT = lambda columns: ", ".join(f"{sql} AS {c}" for c, sql in columns.items())
SQL = {
    "mark_corrections": f"""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, {CABLE} AS clean, {TYPED} AS typed, length(replace({CABLE}, ' ', '')) - 1 AS n FROM part)
  SELECT p_partkey, CASE WHEN k IN (4, 5) THEN typed ELSE clean END AS suggested, round(CASE k WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.88::DOUBLE WHEN 2 THEN least(0.92::DOUBLE, 0.7::DOUBLE + round(2 * n / (2 * n + 1), 6) * 0.25::DOUBLE)
  WHEN 3 THEN least(0.93::DOUBLE, 0.75::DOUBLE + round(2 * n / (2 * n + 1), 6) * 0.2::DOUBLE) WHEN 4 THEN 0.95::DOUBLE ELSE 0::DOUBLE END, 4) AS confidence,
  CASE WHEN k IN (1, 2, 3) THEN 'brand_db' ELSE 'deterministic' END AS source, (['unchanged', 'spelling', 'close', 'spelling and close', 'unchanged', 'empty'])[k + 1] AS reason FROM p""",
    "synonym_codes": f"""WITH w AS (SELECT DISTINCT {_FIRST} AS w FROM part), l AS (SELECT w || CASE WHEN length(w) % 2 = 0 THEN ' ring' ELSE '' END AS phrase, 'C' || length(w) AS code, CASE WHEN length(w) <> 4 THEN 0.5::DOUBLE + length(w) / 100 ELSE 0.7::DOUBLE END AS confidence FROM w),
  s AS (SELECT *, row_number() OVER (ORDER BY phrase, code) AS position FROM l), t AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN left(p_name, 3) ELSE lower(p_name) END AS t FROM part),
  b AS (SELECT * FROM t JOIN s ON contains(t, phrase) OR contains(phrase, t) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY confidence DESC, position) = 1)
  SELECT p_partkey, CASE code WHEN 'C3' THEN 'код три' WHEN 'C5' THEN 'код пять' ELSE code END AS code, confidence FROM b""",
    "customer_hints": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'ООО ' || c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN 'Каменск ' || c_name WHEN 3 THEN 'завод ' || c_nationkey WHEN 4 THEN '' ELSE 'Кабель ' || c_nationkey END AS hint
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "cell_references": """SELECT p_partkey, CASE k WHEN 0 THEN 'ТУ 16.К99-0' || p_size || '-2014' WHEN 1 THEN 'ТУ 3581-00' || p_size || '-2009' WHEN 4 THEN 'ТУ 27-' || p_size ELSE 'общий' END AS document,
  CASE k WHEN 0 THEN '1.' || p_size || '.1' WHEN 1 THEN 'п. 2.' || p_size || ' 3.1' WHEN 2 THEN '1.' || p_size || '.2-1.' || p_size || '.5; 4.1' WHEN 3 THEN 'по чертежу ' || p_name ELSE 'ТУ 27-' || p_size END AS clause,
  CASE k WHEN 0 THEN '1.' || p_size || '.1' WHEN 1 THEN '2.' || p_size || '|3.1' WHEN 2 THEN '1.' || p_size || '.2-1.' || p_size || '.5|4.1' WHEN 3 THEN '' ELSE '27-' || p_size END AS numbers FROM (SELECT *, p_partkey % 5 AS k FROM part)""",
    "organisation_cards": f"""WITH o AS (SELECT {_SELECT(CARDS)}, lower('Завод ' || CAST(floor(c_custkey / 2) AS BIGINT)) AS k FROM customer),
  n AS (SELECT {_SELECT(FOUND)}, CASE s_suppkey % 4 WHEN 2 THEN 'новый ' || (s_suppkey % 14) ELSE 'завод ' || s_suppkey END AS k FROM supplier WHERE s_suppkey % 4 < 3),
  m AS (SELECT n.*, coalesce((SELECT min(org_id) FROM o WHERE o.inn = n.inn), (SELECT min(org_id) FROM o WHERE o.k = n.k AND coalesce(o.inn, '') = coalesce(n.inn, ''))) AS id FROM n),
  g AS (SELECT id, CASE WHEN id IS NULL THEN coalesce(inn, k) END AS unmet, min(position) AS first, arg_max(name, position) AS name, arg_max(k, position) AS k, max(inn) AS inn, arg_max(org_type, position) FILTER (WHERE org_type <> 'unknown') AS org_type,
  bool_or(accredited) AS accredited, arg_max(phone, position) FILTER (WHERE phone IS NOT NULL) AS phone FROM m GROUP BY ALL),
  e AS (SELECT o.org_id, g.id IS NOT NULL AS met, coalesce(g.k, o.k) AS k, coalesce(g.name, o.name) AS name, coalesce(g.inn, o.inn) AS inn, coalesce(g.org_type, o.org_type) AS org_type, o.accredited OR coalesce(g.accredited, false) AS accredited, coalesce(g.phone, o.phone) AS phone FROM o LEFT JOIN g ON g.id = o.org_id),
  t AS (SELECT a.org_id AS keep_id, b.org_id AS drop_id, b.phone FROM e a JOIN e b ON a.k = b.k WHERE a.met AND a.inn IS NOT NULL AND b.inn IS NULL)
  SELECT org_id, name, inn, org_type, accredited, coalesce(phone, (SELECT arg_min(t.phone, drop_id) FILTER (WHERE t.phone IS NOT NULL) FROM t WHERE keep_id = org_id)) AS phone, (SELECT count(*) FROM t WHERE keep_id = org_id) AS n_merged FROM e WHERE org_id NOT IN (SELECT drop_id FROM t)
  UNION ALL SELECT (SELECT max(org_id) FROM o) + 1 + first, name, inn, coalesce(org_type, 'unknown'), accredited, phone, 0 FROM g WHERE id IS NULL""",
}

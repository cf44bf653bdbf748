"""Queries that match text to a catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import extract, text
from ..operators import match, quality
from .common import sql_values, table, values

PATTERNS = [("apache license", "L1", 0.9), ("mit license", "L2", 0.9), ("general public license", "L3", 0.95), ("public license", "L3", 0.8), ("cc by", "L4", 0.85), ("rights reserved", "L5", 0.8), ("licensed under", "L0", 0.7)]
ALIASES = [(1, "old bolt", "A1"), (2, "bolt", "A2"), (3, "gear", "A3"), (4, "red widget", "A4"), (5, "rod", "A5"), (6, "small ring set", "A6")]
TARGETS = [(1, "small steel ring"), (2, "red widget large"), (3, "blue gear"), (4, "hot anvil plate"), (5, "old bolt")]


def phrase_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON12 TXT13: the best confidence of every code whose pattern stands in a document."""
    p = values(spark, PATTERNS, "pattern string, code string, confidence double")
    return match.contained_phrases(table(spark, sf_dir, "documents"), "doc_id", "text", p)


SUGGESTIONS = 3


def phrase_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT14 WIN06 WIN09: a document's suggestions by confidence and code."""
    return match.top(phrase_mapping(spark, sf_dir), ["doc_id"], [F.desc("confidence"), F.asc("code")], SUGGESTIONS).select("doc_id", "code", "confidence")


def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON13 JON14: codes of part names by alias, exact or contained."""
    a = values(spark, ALIASES, "alias_id int, alias string, code string")
    return match.resolve_alias(table(spark, sf_dir, "part"), "p_partkey", "p_name", a)


def token_jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON17 TXT10: the name that shares most words with each part name."""
    t = values(spark, TARGETS, "target_id int, target string")
    best = match.best_by_words(table(spark, sf_dir, "part"), "p_partkey", "p_name", t, "target_id", "target")
    return best.select("p_partkey", "target_id", "shared", F.round("score", 6).alias("score"))


def code_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT11 TXT12 JON22: the first stage that gives a code: exact name, alias, shared words."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    exact = parts.join(match.small(values(spark, TARGETS, "target_id int, target string")), F.col("p_name") == F.col("target")).select("p_partkey", F.concat(F.lit("T"), F.col("target_id")).alias("code"), F.lit(1.0).alias("score"))
    alias = alias_resolve(spark, sf_dir).select("p_partkey", "code", F.lit(0.91).alias("score"))
    words = token_jaccard_match(spark, sf_dir).select("p_partkey", F.concat(F.lit("T"), F.col("target_id")).alias("code"), "score")
    return match.cascade(parts, "p_partkey", [("exact", exact), ("alias", alias), ("words", words)]).select("p_partkey", "code", "score", "method")


def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16 AGG17: how many parts of each brand got a code."""
    brand = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return quality.match_rate(code_cascade(spark, sf_dir).join(brand, "p_partkey"), F.col("code").isNotNull(), ["p_brand"])


def suggestion_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT14 JON12 AGG21: synonyms, built-in rules and learned mappings of parts combined."""
    p = table(spark, sf_dir, "part")
    syn = p.filter("p_size < 30").select("p_partkey", F.col("p_brand").alias("code"), F.lit(0.97).alias("confidence"))
    built = p.filter("p_size % 2 = 0").select("p_partkey", F.col("p_brand").alias("code"), F.lit(0.85).alias("confidence"))
    learned = p.filter("p_size % 3 = 0").select("p_partkey", F.col("p_brand").alias("code"), F.round(match.usage_confidence(F.col("p_size")), 2).alias("confidence"))
    return match.combine_suggestions("p_partkey", syn, built, learned)


def brand_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON22 (its prefix branch): the longest known prefix of a designation."""
    known = table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("brand"))
    marks = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", " ", "").alias("mark"))
    return match.longest_prefix(marks.filter("mark <> ''"), "p_partkey", "mark", known.filter("brand <> ''"), "brand")


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON15 WIN06: close designations of compatible brands, and what a designation is snapped to; a fuzzy ratio has no SQL."""
    n = table(spark, sf_dir, "part")
    return match.fuzzy_names(n.select(F.col("p_name").alias("left_name")), "left_name", n.select(F.col("p_name").alias("right_name")), "right_name", rules.MARK_MIN, rules.MARK_STRICT, 5)


#: Names of customers as they are typed: with legal forms, quotes and signs, as logins, as placeholders: SQL over customer.
TYPED = """CASE c_custkey % 7 WHEN 0 THEN 'ООО "' || c_name || '"' WHEN 1 THEN 'ооо  ' || c_name WHEN 2 THEN 'ПАО «' || c_name || ', №' || c_nationkey || '»' WHEN 3 THEN c_name || ' Ltd.' WHEN 4 THEN 'Заказчик'
  WHEN 5 THEN 'a.' || lower(c_mktsegment) ELSE 'Общество с ограниченной ответственностью ' || c_name END"""


def org_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT15 FLT04: keys under which organisations are equal, and the names that are none."""
    name = F.expr(TYPED)
    return table(spark, sf_dir, "customer").select("c_custkey", text.organisation_key(name).alias("org_key"), extract.placeholder(name).alias("placeholder"))


QUERIES = {f.__name__: f for f in (phrase_mapping, phrase_suggestions, alias_resolve, token_jaccard_match, code_cascade, match_rate, suggestion_precedence, brand_snap, fuzzy_names, org_names)}
_NORM = "trim(regexp_replace(regexp_replace(translate(lower({}), 'ё±+-–—', 'е     '), '[^\\p{{L}}\\p{{N}}_\\s/%°]', ' ', 'g'), '\\s+', ' ', 'g'))"
_LOW = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(string_split({}, ' '), lambda w: length(w) >= 3))"
_MAP = f"""SELECT doc_id, code, max(confidence) AS confidence, arg_max(pattern, (confidence, length(pattern), pattern)) AS pattern
  FROM documents JOIN {sql_values(PATTERNS, 'pattern, code, confidence')} ON contains({_LOW.format('text')}, pattern) GROUP BY doc_id, code"""
_ALIAS = f"""SELECT p_partkey, arg_min(code, (p <> alias, alias_id)) AS code, bool_or(p = alias) AS exact FROM (SELECT p_partkey, {_NORM.format('p_name')} AS p FROM part)
  JOIN {sql_values(ALIASES, 'alias_id, alias, code')} ON p = alias OR (length(alias) >= 4 AND (contains(p, alias) OR contains(alias, p))) GROUP BY p_partkey"""
_JACCARD = f"""SELECT p_partkey, target_id, shared, round(score, 6) AS score FROM (SELECT p_partkey, target_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared,
  len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS score
  FROM (SELECT p_partkey, {_WORDS.format(_NORM.format('p_name'))} AS a FROM part), (SELECT target_id, {_WORDS.format(_NORM.format('target'))} AS b FROM {sql_values(TARGETS, 'target_id, target')}))
  WHERE score >= 0.42 AND (shared >= 2 OR score >= 0.55) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, target_id) = 1"""
_CASCADE = f"""WITH al AS ({_ALIAS}), j AS ({_JACCARD}), t AS (SELECT * FROM {sql_values(TARGETS, 'target_id, target')})
  SELECT p_partkey, coalesce('T' || t.target_id, al.code, 'T' || j.target_id) AS code,
  CAST(CASE WHEN t.target_id IS NOT NULL THEN 1 WHEN al.code IS NOT NULL THEN 0.91 ELSE j.score END AS DOUBLE) AS score,
  CASE WHEN t.target_id IS NOT NULL THEN 'exact' WHEN al.code IS NOT NULL THEN 'alias' WHEN j.target_id IS NOT NULL THEN 'words' END AS method
  FROM part LEFT JOIN t ON target = p_name LEFT JOIN al USING (p_partkey) LEFT JOIN j USING (p_partkey)"""
SQL = {
    "phrase_mapping": f"SELECT doc_id, code, CAST(confidence AS DOUBLE) AS confidence, pattern FROM ({_MAP})",
    "phrase_suggestions": f"SELECT doc_id, code, CAST(confidence AS DOUBLE) AS confidence FROM ({_MAP}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, code) <= {SUGGESTIONS}",
    "alias_resolve": _ALIAS,
    "token_jaccard_match": _JACCARD,
    "code_cascade": _CASCADE,
    "match_rate": f"SELECT p_brand, count(code) AS n_matched, count(*) AS n_total, round(count(code) / count(*), 4) AS rate, 'сопоставлено ' || count(code) || '/' || count(*) || ' (' || CAST(round(100 * count(code) / count(*)) AS INTEGER) || '%)' AS summary FROM ({_CASCADE}) JOIN part USING (p_partkey) GROUP BY p_brand",
    "suggestion_precedence": """WITH s AS (SELECT p_partkey, p_brand AS code, CASE WHEN p_size % 2 = 0 THEN CAST(0.85 AS DOUBLE) WHEN p_size < 30 THEN CAST(0.97 AS DOUBLE) END AS base,
  CASE WHEN p_size % 3 = 0 THEN CAST(round(least(0.95, 0.8 + least(p_size, 10) * 0.01), 2) AS DOUBLE) END AS l, p_size FROM part)
  SELECT p_partkey, code, CASE WHEN base IS NULL OR l > base THEN l ELSE base END AS confidence, CASE WHEN l IS NOT NULL AND (base IS NULL OR l > base) THEN 'learned' WHEN p_size % 2 = 0 THEN 'builtin' ELSE 'synonym' END AS source
  FROM s WHERE base IS NOT NULL OR l IS NOT NULL""",
    "brand_snap": "SELECT p_partkey, arg_max(brand, length(brand)) AS brand FROM part JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS brand FROM part) ON starts_with(replace(p_name, ' ', ''), brand) GROUP BY p_partkey",
    "org_names": """SELECT c_custkey, CASE c_custkey % 7 WHEN 2 THEN lower(c_name) || ', №' || c_nationkey WHEN 3 THEN lower(c_name) || ' ltd' WHEN 4 THEN 'заказчик' WHEN 5 THEN 'a.' || lower(c_mktsegment) ELSE lower(c_name) END AS org_key,
  c_custkey % 7 IN (4, 5) AS placeholder FROM customer""",
}

"""Queries that join names by likeness and containment, with their SQL where no matching-blocks ratio is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import marks, text
from ..operators import match, similar
from ..scratch import save
from .common import table

#: Three neighbouring words of a text are the bare name of an organisation.
_WORDS = r"[^\s,.]+( [^\s,.]+){2}"


def organisations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers (org_id, name, org_key) named by documents; suppliers' names are whole, shortened or misspelt."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", _WORDS, 0).alias("w")).filter("w <> ''")
    c = table(spark, sf_dir, "customer").join(words.hint("merge"), F.col("c_custkey") == F.col("doc_id")).select(F.col("c_custkey").alias("org_id"), F.concat(F.when(F.col("c_nationkey") % 2 == 0, "ООО ").otherwise(""), F.lit('"'), "w", F.lit('"')).alias("name"))
    kind = F.col("s_suppkey") % 3
    own = F.when(kind == 0, F.concat(F.lit("«"), "w", F.lit("»"))).when(kind == 1, F.regexp_replace("w", " [^ ]+$", "")).otherwise(F.concat(F.substring("w", 1, 4), F.expr("substring(w, 6)")))
    s = table(spark, sf_dir, "supplier").join(words.hint("merge"), F.col("s_suppkey") == F.col("doc_id")).select(F.col("s_suppkey").alias("org_id"), own.alias("name"))
    keyed = lambda df: df.withColumn("org_key", text.organisation_key(F.col("name")))
    return keyed(c), keyed(s)


def _similar(spark: SparkSession, sf_dir: str, fuzzy: bool) -> DataFrame:
    known, probes = map(save, organisations(spark, sf_dir))  # else the documents are read again for every step
    asked = probes.select("org_id", "org_key")
    there = known.select(F.col("org_id").alias("similar_id"), "name", "org_key")
    return similar.similar_organisations(asked, "org_id", there, "similar_id", "name", "org_key", rules.ORG_MIN, rules.ORG_CONTAINED, rules.ORG_TOP, fuzzy)


def org_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON16: customers whose names resemble a supplier's (ratio, containment, equality); a matching-blocks ratio has no SQL."""
    return _similar(spark, sf_dir, True)


def org_same_or_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON16 without its ratio: customers whose normalised names equal, contain or are inside a supplier's."""
    return _similar(spark, sf_dir, False)


def altered_name(name, key):
    """A name as it may be misspelt or extended, by its key; for columns and for plain strings."""
    if not isinstance(name, Column):
        return [name, name[:2] + name[3:], name + "нг(А)-LS", name.upper()][key % 4]
    return F.when(key % 4 == 0, name).when(key % 4 == 1, F.concat(F.substring(name, 1, 2), F.substr(name, F.lit(4)))).when(key % 4 == 2, F.concat(name, F.lit("нг(А)-LS"))).otherwise(F.upper(name))


def lexicon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON23: misspelt part names looked up among the known ones: equal, equal without fire class, nearest; no SQL for the last."""
    p = table(spark, sf_dir, "part")
    known = p.select(F.col("p_name").alias("brand")).distinct().withColumn("brand_key", match.similarity_key(F.col("brand")))
    asked = p.select(altered_name(F.col("p_name"), F.col("p_partkey")).alias("name"))
    return similar.lookup_known(asked, "name", match.similarity_key(F.col("name")), match.similarity_key(marks.bare_brand(F.col("name"))), known, "brand", "brand_key", rules.BRAND_MIN)


def brand_ratio_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON22 with its ratio: the known first word that a misspelt one begins, is begun by, or resembles most; no SQL."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ")[0].alias("brand"))
    asked = p.select(altered_name(F.col("brand"), F.col("p_partkey") % 2).alias("prefix"))
    return similar.snap_prefix(asked, "prefix", p, "brand", rules.BRAND_MIN)


def contained_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN02: words of each conversation that neither begin a longer one nor (from eight letters on) stand inside one."""
    words = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    return similar.drop_contained(words, "conv_id", "word", rules.INSIDE_MIN, F.upper("name").rlike("^(" + "|".join(rules.CATALOGUE_FAMILIES) + ")"))


QUERIES = {f.__name__: f for f in (org_similar, org_same_or_contained, lexicon_lookup, brand_ratio_snap, contained_drop)}
_KEY = "regexp_replace(regexp_replace(trim(regexp_replace(translate(lower({}), '«»\"''`{{}}[]', ''), '\\s+', ' ', 'g')), '^ооо ', ''), '^[ .,;-]+|[ .,;-]+$', '', 'g')"
SQL = {
    "org_same_or_contained": f"""WITH w AS (SELECT doc_id, regexp_extract(text, '[^\\s,.]+( [^\\s,.]+){{2}}', 0) AS w FROM documents),
  c AS (SELECT c_custkey AS similar_id, CASE WHEN c_nationkey % 2 = 0 THEN 'ООО ' ELSE '' END || '"' || w || '"' AS name FROM customer JOIN w ON c_custkey = doc_id WHERE w <> ''),
  s AS (SELECT s_suppkey AS org_id, CASE s_suppkey % 3 WHEN 0 THEN '«' || w || '»' WHEN 1 THEN regexp_replace(w, ' [^ ]+$', '') ELSE w[1:4] || w[6:] END AS name FROM supplier JOIN w ON s_suppkey = doc_id WHERE w <> ''),
  p AS (SELECT org_id, similar_id, c.name, {_KEY.format('s.name')} AS a, {_KEY.format('c.name')} AS b FROM s JOIN c ON contains({_KEY.format('s.name')}, {_KEY.format('c.name')}) OR contains({_KEY.format('c.name')}, {_KEY.format('s.name')}))
  SELECT org_id, similar_id, name, round_even(CASE WHEN a = b THEN 1.0::DOUBLE ELSE greatest(0.88::DOUBLE, 2.0 * least(length(a), length(b)) / (length(a) + length(b))) END, 3) AS score
  FROM p WHERE a <> '' AND b <> '' QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY score DESC, name, similar_id) <= 8""",
    "contained_drop": """WITH n AS (SELECT DISTINCT conv_id, w AS word FROM (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM conversations) WHERE w <> '')
  SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n AS m WHERE m.conv_id = n.conv_id AND length(m.word) > length(n.word) AND (starts_with(m.word, n.word) OR (length(n.word) >= 8 AND contains(m.word, n.word))))""",
}

"""Queries whose rules are read from files: families, replacements, the code cascade, mined and promoted candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match, mining, rulebook
from ..scratch import folder, save
from ..sources import files
from .common import sql_values, table, values
from .matching import _ALIAS, _JACCARD, TARGETS, alias_resolve, token_jaccard_match

FAMILIES = [("licence", 1, 0.3, True), ("private", 2, 0.5, True), ("code", 3, 0.4, True), ("off", 0, 0.0, False), ("list", 3, 0.4, True)]
PARTS = [("licence", "marker", "licen[cs]ed?"), ("licence", "marker", "rights\\s+reserved"), ("licence", "sender", "^the"), ("licence", "brand", "CC BY"), ("private", "hint", "@[a-z]+"), ("private", "hint", "\\+[0-9]{1,2} "), ("private", "marker", "phone|mail"), ("code", "marker", "token\\s*="), ("code", "hint", "[0-9a-f]{16}"), ("code", "marker", "key"), ("off", "marker", "."), ("list", "marker", "%%%|###"), ("list", "marker", "\\|"), ("list", "sender", "^[0-9]")]
REPAIRS = [(1, "[|]{2,}", "|"), (2, "%%+", "%"), (3, "th([aeiou])", "z$1"), (4, "z[aeiou]n", "N"), (5, "\\s+", " ")]
PHRASES = [(1, "^small (bolt|rod)", "T1"), (2, "gear", "T3"), (3, "(red|blue) plate", "X9"), (4, "plate", "T4"), (5, "widget$", "T2")]
PATTERNS = {"licence": r"[Ll]icensed under [A-Za-z0-9 .-]{3,40}", "token": r"[a-z_]{3,} = ", "name": r"[A-Z][a-z]{3,}(?: [A-Z][a-z]{3,})+"}
NOISE = "test|example"


def _read(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table as it is kept: JSON lines, read back."""
    work = folder(spark)
    values(spark, rows, schema).write.json(work)
    return files.json_table(spark, work, schema, multi_line=False)[0]


def family_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS05 SRC17 WIN08: the family of each document by rule tables: markers, hints that lift, senders, brands, own thresholds."""
    families = _read(spark, FAMILIES, "family string, priority int, threshold double, enabled boolean")
    return rulebook.detect_family(table(spark, sf_dir, "documents"), "doc_id", "text", families, _read(spark, PARTS, "family string, part string, pattern string"))


def ordered_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT24 TXT34: texts of conversations after a table of replacements, each on what the ones before have left."""
    repaired = rulebook.replace_in_order(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", _read(spark, REPAIRS, "position int, pattern string, replacement string"), "repaired")
    return repaired.select("conv_id", "turn", F.md5("repaired").alias("digest"), F.length("repaired").alias("n_chars"))


def five_stage_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT11 TXT12 JON13 JON17: codes of parts by ordered phrase rules (with what the context changes), aliases, equal names,
    contained names and shared words; a code that the catalogue lacks leaves the part to the next stage."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    names = values(spark, [(i, n, f"T{i}") for i, n in TARGETS] + [(9, "gear for optical lines", "T3O")], "position int, name string, code string")
    ruled = rulebook.first_rule(parts, "p_name", _read(spark, PHRASES, "position int, pattern string, code string"), names.select("code")).filter("rule IS NOT NULL")
    optical = (F.col("rule.code") == "T3") & F.col("p_brand").rlike("#1")
    rules = ruled.select("p_partkey", F.when(optical, "T3O").otherwise(F.col("rule.code")).alias("code"), F.when(optical, 0.93).otherwise(0.95).alias("score"))
    alias = alias_resolve(spark, sf_dir).select("p_partkey", "code", F.lit(0.91).alias("score"))
    exact = parts.join(match.small(names), F.lower("p_name") == F.lower("name")).select("p_partkey", "code", F.lit(1.0).alias("score"))
    inside = rulebook.contained_name(parts, "p_partkey", "p_name", names).select("p_partkey", "code", F.lit(0.88).alias("score"))
    words = token_jaccard_match(spark, sf_dir).select("p_partkey", F.concat(F.lit("T"), F.col("target_id")).alias("code"), "score")
    return match.cascade(parts, "p_partkey", [("phrase", rules), ("alias", alias), ("exact", exact), ("inside", inside), ("words", words)])


def mined_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT35: what patterns find in documents, with counts and up to three example documents each."""
    got = mining.candidates(table(spark, sf_dir, "documents"), "doc_id", "text", PATTERNS, 8, NOISE, 3)
    return got.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


def promoted_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT36: phrases of up to four words in at least three conversations; those that meet a phrase rule are promoted, others queue for review."""
    turns = table(spark, sf_dir, "conversations")
    texts = turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")
    found = mining.frequent_phrases(texts, "id", words, 3, 4, save, shortest=2)
    return mining.review_queue(found, F.when(F.rlike("phrase", F.lit("^the ")), "the").when(F.rlike("phrase", F.lit("tion( |$)")), "tion"))


QUERIES = {f.__name__: f for f in (family_rules, ordered_repairs, five_stage_codes, mined_candidates, promoted_phrases)}


def _sql_hits(part: str) -> str:
    patterns = lambda f: [p for g, q, p in PARTS if g == f and q == part]
    one = lambda p: f"CAST(regexp_matches(head, '{p}', 'i') AS INTEGER)" if part != "brand" else f"CAST(contains(lower(head), '{p.lower()}') AS INTEGER)"
    return "CASE family " + " ".join(f"WHEN '{f}' THEN {' + '.join(map(one, patterns(f))) or 0}" for f, *_ in FAMILIES) + " END"


def _sql_size(part: str) -> str:
    return "CASE family " + " ".join(f"WHEN '{f}' THEN {sum(g == f and q == part for g, q, _ in PARTS)}" for f, *_ in FAMILIES) + " END"


_REPAIRED = "text"
for _, _p, _r in REPAIRS:
    _REPAIRED = f"regexp_replace({_REPAIRED}, '{_p}', '{_r.replace('$', chr(92))}', 'gi')"
_NAMES = sql_values([(i, n, f"T{i}") for i, n in TARGETS] + [(9, "gear for optical lines", "T3O")], "position, name, code")
_RULED = " ".join(f"WHEN regexp_matches(p_name, '{p}', 'i') THEN {repr(c) if c.startswith('T') else 'NULL'}" for _, p, c in PHRASES)
SQL = {
    "family_rules": f"""WITH d AS (SELECT doc_id, left(coalesce(text, ''), 4000) AS head FROM documents),
  n AS (SELECT doc_id, head, family, priority, threshold, {_sql_hits('marker')} AS m, {_sql_hits('hint')} AS h, {_sql_hits('sender')} AS s, {_sql_hits('brand')} > 0 AS b,
    {_sql_size('marker')} + {_sql_size('hint')} + {_sql_size('sender')} AS total, {_sql_size('hint')} AS hints FROM d, {sql_values([f[:3] for f in FAMILIES if f[3]], 'family, priority, threshold')}),
  u AS (SELECT *, CASE WHEN h > 0 THEN greatest((m + h + s) / total, 0.25::DOUBLE + h / hints * 0.65::DOUBLE) ELSE (m + h + s) / total END AS lifted FROM n),
  j AS (SELECT doc_id, family, priority, threshold, CASE WHEN head = '' THEN 0 ELSE floor(CASE WHEN b THEN least(1.0::DOUBLE, lifted + 0.2::DOUBLE) ELSE lifted END * 100 + 0.5) / 100 END AS score FROM u)
  SELECT doc_id, CASE WHEN score > 0 AND score >= threshold THEN family END AS family, score::DOUBLE AS score FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, priority, family) = 1""",
    "ordered_repairs": f"SELECT conv_id, turn, md5(r) AS digest, length(r)::INTEGER AS n_chars FROM (SELECT conv_id, turn, {_REPAIRED} AS r FROM conversations)",
    "five_stage_codes": f"""WITH al AS ({_ALIAS}), j AS ({_JACCARD}), t AS (SELECT * FROM {_NAMES}),
  r AS (SELECT p_partkey, p_name, CASE {_RULED} END AS rule, regexp_matches(p_brand, '#1') AS optical FROM part),
  i AS (SELECT p_partkey, arg_min(code, position) AS code FROM part JOIN t ON length(p_name) >= 8 AND (contains(lower(p_name), name) OR contains(name, lower(p_name))) GROUP BY p_partkey)
  SELECT p_partkey, coalesce(CASE WHEN rule = 'T3' AND optical THEN 'T3O' ELSE rule END, al.code, t.code, i.code, 'T' || j.target_id) AS code,
  CAST(CASE WHEN rule = 'T3' AND optical THEN 0.93 WHEN rule IS NOT NULL THEN 0.95 WHEN al.code IS NOT NULL THEN 0.91 WHEN t.code IS NOT NULL THEN 1 WHEN i.code IS NOT NULL THEN 0.88 ELSE j.score END AS DOUBLE) AS score,
  CASE WHEN rule IS NOT NULL THEN 'phrase' WHEN al.code IS NOT NULL THEN 'alias' WHEN t.code IS NOT NULL THEN 'exact' WHEN i.code IS NOT NULL THEN 'inside' WHEN j.target_id IS NOT NULL THEN 'words' END AS method
  FROM r LEFT JOIN al USING (p_partkey) LEFT JOIN t ON lower(p_name) = t.name LEFT JOIN i USING (p_partkey) LEFT JOIN j USING (p_partkey)""",
    "mined_candidates": "WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(coalesce(text, ''), '{p}')) AS c FROM documents" for kind, p in PATTERNS.items()) + f"""),
  g AS (SELECT doc_id, kind, lower(trim(regexp_replace(c, '\\s+', ' ', 'g'))) AS candidate FROM f),
  p AS (SELECT kind, candidate, doc_id, count(*) AS n FROM g WHERE length(candidate) >= 8 AND NOT regexp_matches(candidate, '{NOISE}') GROUP BY ALL)
  SELECT kind, candidate, count(*) AS n_docs, sum(n)::BIGINT AS n_places, array_to_string(list(doc_id ORDER BY md5(kind || '|' || candidate || '|' || doc_id), doc_id)[1:3], ',') AS examples FROM p GROUP BY kind, candidate""",
    "promoted_phrases": """WITH w AS (SELECT conv_id || '-' || turn AS id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+') AS w FROM conversations),
  g AS (SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM w, unnest(range(2, 5)) AS a(n), unnest(range(1, len(w) - n + 2)) AS b(i) WHERE NOT list_contains(w[i:i + n - 1], ''))
  SELECT phrase, n::INTEGER AS n_words, count(*) AS support, CASE WHEN starts_with(phrase, 'the ') THEN 'the' WHEN regexp_matches(phrase, 'tion( |$)') THEN 'tion' END AS code,
  CASE WHEN starts_with(phrase, 'the ') OR regexp_matches(phrase, 'tion( |$)') THEN 'promoted' ELSE 'needs_review' END AS status FROM g GROUP BY phrase, n HAVING count(*) >= 3""",
}

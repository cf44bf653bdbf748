"""Queries of text functions and classification, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import marks, text
from ..operators import ranking, relational
from ..sources import files
from .common import spread, table

CAP = 60_000


def line_dedupe_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN04 ARR01: texts without lines equal to the line before."""
    d = table(spark, sf_dir, "documents")
    lines = text.drop_repeated_neighbours(F.split("text", "\n"))
    return d.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.size(lines).cast("long").alias("n_kept"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def unique_lines_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN05: texts without lines seen before, up to the size cap."""
    out = ranking.unique_lines(table(spark, sf_dir, "documents"), "doc_id", "text", CAP)
    return out.select("doc_id", "n_lines", F.sha2("compact", 256).alias("sha256"))


def keyword_test_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS04: kind of document by ordered keyword lists, on the driver's own words."""
    kinds = [("licence", ["licensed", "license"]), ("contact", ["@", "call"]), ("plain", ["the "])]
    return table(spark, sf_dir, "documents").select("doc_id", text.first_match(F.col("text"), kinds, "other").alias("kind"))


def letter_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG23 CLS09: share of Cyrillic letters, and whether the text layer is good enough."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    d = spread(d, d.count(), "doc_id", each=1 << 14)
    return d.select("doc_id", F.round(text.letters_share(F.col("text"), "aeiouAEIOU"), 4).alias("vowels"), text.needs_ocr(F.col("text"), F.col("n_chars") > 1000).alias("needs_ocr"))


def phrase_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT10 TXT29 TXT31: normal form, slug and file name of event payloads' text and of part names."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" / ", "p_type", "p_name", "p_brand").alias("t"))
    return p.select("p_partkey", text.phrase(F.col("t")).alias("phrase"), F.array_join(text.word_set(F.col("t")), ",").alias("words"), text.slug(F.col("t"), 20).alias("slug"), text.file_part(F.col("t"), 12).alias("file_part"))


#: Clause lists of order lines: ranges of 1 to 50 clauses, some with more clauses behind: SQL over lineitem.
CLAUSES = "'2.' || l_linenumber || '.1 - 2.' || l_linenumber || '.' || CAST(l_quantity AS INT) || CASE l_partkey % 3 WHEN 0 THEN ', 7.1; 7.2,7.1' WHEN 1 THEN '; 9.8 - 9.4' ELSE '' END"


def clause_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT06 TXT07: clause lists with ranges, each distinct list expanded once, with its uses."""
    raw = table(spark, sf_dir, "lineitem").groupBy(F.expr(CLAUSES).alias("raw")).agg(F.count("*").alias("n"))
    return raw.select("raw", "n", F.array_join(text.clauses(F.col("raw")), "|").alias("clauses"))


#: Designations of parts in five spellings: SQL over part.
SPELLINGS = "CASE p_partkey % 5 WHEN 0 THEN 'BBГнг(A)-LS  ' || p_size || 'х2,5' WHEN 1 THEN 'ввгнг(a)-ls ' || p_size || 'x2.5' WHEN 2 THEN 'КПСнг ' || p_size || ' X 2х0,5' WHEN 3 THEN 'ПВБШв ' || p_size || '*1,5' ELSE 'кабель ' || p_name END"


def mark_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT01 TXT22 TXT25: keys and parts of designations, and their spelling mended after OCR."""
    mark = F.expr(SPELLINGS)
    m = marks.parse_mark(mark)
    return table(spark, sf_dir, "part").select("p_partkey", text.mark_key(mark).alias("key"), *[m[c].alias(c) for c in ("brand", "cores", "groups", "size", "has_armor", "is_lan")], marks.after_ocr(mark).alias("mended"))


def json_props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR07 ARR10 FLT08: JSON text as a map, with a fallback for bad text."""
    e = table(spark, sf_dir, "events").withColumn("raw", F.when(F.col("event_id") % 10 == 0, "not json").otherwise(F.col("props")))
    props = files.json_map(F.col("raw"))
    return e.select("event_id", F.coalesce(F.try_element_at(props, F.lit("k")), F.lit("-")).alias("k"), F.size(props).cast("long").alias("n_keys"))


#: An OCR table of three words for each part, one of them often without confidence: SQL over part.
TSV = "concat_ws(chr(10), concat_ws(chr(9), '5', '1', '1', '1', '1', '1', '10', '20', '30', '40', CAST(p_size AS STRING) || '.5', p_brand), concat_ws(chr(9), '5', '1', '1', '1', '1', '2', '10', '20', '30', '40', CASE WHEN p_partkey % 3 = 0 THEN '-1' ELSE '80' END, p_type), concat_ws(chr(9), '5', '1', '1', '1', '1', '3', '50', '20', '30', '40', '96', CASE WHEN p_size % 4 = 0 THEN '' ELSE '3х2,5' END))"


def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC30 AGG11: words of OCR tables and their mean confidence; words without text or confidence do not count."""
    w = files.ocr_words(F.expr(TSV))
    mean = F.aggregate(w, F.lit(0.0), lambda a, x: a + x["conf"]) / F.greatest(F.size(w), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(w).cast("long").alias("n_words"), F.round(mean, 4).alias("confidence"), F.array_join(F.transform(w, lambda x: x["text"]), " ").alias("words"))


FAMILIES = [("licence", 1, 0.5, ["licensed", "license"]), ("personal", 2, 0.5, ["@", "example"]), ("code", 3, 0.3, ["token", "key", "="])]


def family_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS05 WIN08 SRC17: share of a family's markers in the text; the best family over its own threshold."""
    low = F.lower("text")
    score = lambda ms: sum((F.when(F.contains(low, F.lit(m)), 1).otherwise(0) for m in ms), F.lit(0)) / F.lit(len(ms))
    rows = F.array(*[F.struct((-F.round(score(ms), 4)).alias("s"), F.lit(p).alias("p"), F.lit(name).alias("name"), F.lit(t).alias("t")) for name, p, t, ms in FAMILIES])
    best = F.array_min(F.filter(rows, lambda r: -r["s"] >= r["t"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(best["name"], F.lit("-")).alias("family"), F.coalesce(-best["s"], F.lit(0.0)).alias("score"))


def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC06 AGG06: turns of a conversation in order, flattened to one text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.squeeze(F.col("text")).alias("t"))
    n = relational.nested(c, "conv_id", ["turn", "role", "t"], [], "turns")
    return n.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", lambda x: F.concat_ws(": ", x["role"], x["t"])), "\n"), 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (line_dedupe_consecutive, unique_lines_cap, keyword_test_type, letter_ratio, phrase_tokens, clause_range_expand, mark_parse, json_props_parse, ocr_confidence, family_score, conversation_text)}
_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
SQL = {
    "line_dedupe_consecutive": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
  k AS (SELECT doc_id, a, [a[i] FOR i IN range(1, len(a) + 1) IF i = 1 OR a[i] <> a[i - 1]] AS b FROM l)
  SELECT doc_id, len(a) AS n_lines, len(b) AS n_kept, sha256(array_to_string(b, chr(10))) AS sha256 FROM k""",
    "unique_lines_cap": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  u AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY ALL), s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS size FROM u)
  SELECT doc_id, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS sha256 FROM s WHERE size <= {CAP} GROUP BY doc_id""",
    "keyword_test_type": f"""WITH t AS (SELECT doc_id, lower({_SQUEEZE.format('text')}) AS t FROM documents)
  SELECT doc_id, CASE WHEN t LIKE '%licensed%' OR t LIKE '%license%' THEN 'licence' WHEN t LIKE '%@%' OR t LIKE '%call%' THEN 'contact' WHEN t LIKE '%the %' THEN 'plain' ELSE 'other' END AS kind FROM t""",
    "letter_ratio": """WITH t AS (SELECT *, length(regexp_replace(text, '[^A-Za-zА-Яа-яЁё]', '', 'g')) AS n FROM documents)
  SELECT doc_id, CASE WHEN n > 0 THEN round(length(regexp_replace(text, '[^aeiouAEIOU]', '', 'g')) / n, 4) ELSE 0 END AS vowels, trim(text) = '' OR n_chars > 1000 AS needs_ocr FROM t""",
    "phrase_tokens": """WITH t AS (SELECT p_partkey, p_type || ' / ' || p_name || ' / ' || p_brand AS t FROM part),
  p AS (SELECT *, trim(regexp_replace(regexp_replace(translate(lower(t), 'ё±+-–—', 'е     '), '[^\\p{L}\\p{N}_\\s/%°]', ' ', 'g'), '\\s+', ' ', 'g')) AS phrase FROM t)
  SELECT p_partkey, phrase, array_to_string(list_sort(list_distinct(list_filter(string_split(phrase, ' '), lambda w: length(w) >= 3))), ',') AS words,
  left(replace(trim(regexp_replace(lower(t), '[^0-9a-zа-яё_]+', ' ', 'g')), ' ', '_'), 20) AS slug, left(trim(regexp_replace(replace(t, '/', ' '), '\\s+', ' ', 'g')), 12) AS file_part FROM p""",
    "clause_range_expand": """WITH g AS (SELECT l_linenumber AS l, CAST(l_quantity AS INT) AS q, l_partkey % 3 AS k, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT '2.' || l || '.1 - 2.' || l || '.' || q || CASE k WHEN 0 THEN ', 7.1; 7.2,7.1' WHEN 1 THEN '; 9.8 - 9.4' ELSE '' END AS raw, n,
  CASE WHEN q <= 40 THEN array_to_string(['2.' || l || '.' || i FOR i IN range(1, q + 1)], '|') ELSE '2.' || l || '.1 - 2.' || l || '.' || q END || CASE k WHEN 0 THEN '|7.1|7.2' WHEN 1 THEN '|9.8 - 9.4' ELSE '' END AS clauses FROM g""",
    "mark_parse": """SELECT p_partkey, CASE k WHEN 0 THEN 'bbгнг(a)-ls' || p_size || 'x2.5' WHEN 1 THEN 'ввгнг(a)-ls' || p_size || 'x2.5' WHEN 2 THEN 'кпснг' || p_size || 'x2x0.5' WHEN 3 THEN 'пвбшв' || p_size || '*1.5' ELSE 'кабель' || replace(p_name, ' ', '') END AS key,
  (['BBГнг(A)-LS', 'ввгнг(a)-ls', 'КПСнг', 'ПВБШв', 'кабель'])[k + 1] AS brand, CAST(CASE k WHEN 2 THEN 2 * p_size WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE p_size END AS INTEGER) AS cores, CAST(CASE k WHEN 2 THEN p_size ELSE 1 END AS INTEGER) AS groups,
  CAST((['2.5', '2.5', '0.5', '1', '1'])[k + 1] AS DOUBLE) AS size, k = 3 AS has_armor, k = 2 AS is_lan,
  CASE k WHEN 0 THEN 'ВВГнг(А)-LS ' || p_size || 'х2,5' WHEN 1 THEN 'ввгнг(а)-ls ' || p_size || 'х2.5' WHEN 2 THEN 'КПСнг ' || p_size || 'х2х0,5' WHEN 3 THEN 'ПВБШв ' || p_size || 'х1,5' ELSE 'кабель ' || p_name END AS mended FROM (SELECT *, p_partkey % 5 AS k FROM part)""",
    "json_props_parse": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '-' ELSE coalesce(json_extract_string(props, '$.k'), '-') END AS k, CASE WHEN event_id % 10 = 0 THEN 0 ELSE len(json_keys(props)) END AS n_keys FROM events",
    "ocr_confidence": """WITH w AS (SELECT p_partkey, p_size + 0.5 AS c1, p_brand AS w1, CASE WHEN p_partkey % 3 > 0 THEN 80 END AS c2, p_type AS w2, CASE WHEN p_size % 4 > 0 THEN 96 END AS c3, '3х2,5' AS w3 FROM part)
  SELECT p_partkey, CAST(1 + (c2 IS NOT NULL)::INT + (c3 IS NOT NULL)::INT AS BIGINT) AS n_words, round(CAST((c1 + coalesce(c2, 0) + coalesce(c3, 0)) AS DOUBLE) / (1 + (c2 IS NOT NULL)::INT + (c3 IS NOT NULL)::INT), 4) AS confidence,
  concat_ws(' ', w1, CASE WHEN c2 IS NOT NULL THEN w2 END, CASE WHEN c3 IS NOT NULL THEN w3 END) AS words FROM w""",
    "family_score": """WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (
  SELECT doc_id, 'licence' AS family, 1 AS p, 0.5 AS least, round(((t LIKE '%licensed%')::INT + (t LIKE '%license%')::INT) / 2, 4) AS score FROM t UNION ALL
  SELECT doc_id, 'personal', 2, 0.5, round(((t LIKE '%@%')::INT + (t LIKE '%example%')::INT) / 2, 4) FROM t UNION ALL
  SELECT doc_id, 'code', 3, 0.3, round(((t LIKE '%token%')::INT + (t LIKE '%key%')::INT + (t LIKE '%=%')::INT) / 3, 4) FROM t),
  b AS (SELECT * FROM s WHERE score >= least QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p) = 1)
  SELECT doc_id, coalesce(family, '-') AS family, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM documents LEFT JOIN b USING (doc_id)""",
    "conversation_text": f"""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || ': ' || t, chr(10) ORDER BY turn, role, t)) AS sha256
  FROM (SELECT conv_id, turn, role, {_SQUEEZE.format('text')} AS t FROM conversations) GROUP BY conv_id""",
}

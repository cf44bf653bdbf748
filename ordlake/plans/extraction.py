"""Queries that read facts out of request documents, which are put together from orders, customers, lines and parts.

The inputs are SQL expressions that both engines read, so a document is the same text for the query and for its SQL. The
SQL then derives the answer from the columns that went into the text, not from the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, text
from ..operators import journal, validate
from ..scratch import folder, save
from .common import spread, table

_N = "CAST({} AS STRING)".format
_DATE = f"lpad({_N('day(o_orderdate)')}, 2, '0') || '.' || lpad({_N('month(o_orderdate)')}, 2, '0') || '.' || {_N('year(o_orderdate)')}"
#: What goes into a request, by name: SQL over orders and customer.
PIECES = {
    "nr": "lpad(" + _N("o_custkey % 1000") + ", 3, '0')",
    "cable": "CASE o_orderkey % 3 WHEN 0 THEN 'ВВГнг(А)-LS' WHEN 1 THEN 'КПСнг(А)-FRHF' ELSE 'ПВС' END",
    "cores": "o_custkey % 37 + 1",
    "section": f"{_N('o_custkey % 16 + 1')} || CASE WHEN o_orderkey % 2 = 0 THEN ',5' ELSE '' END",
    "a": "o_custkey % 9 + 1",
    "b": "c_nationkey + 1",
    "sent": _DATE,
    "tests": "CASE o_orderstatus WHEN 'F' THEN 'сертификационные' WHEN 'O' THEN 'контрольные' ELSE 'периодические' END",
    "inn": f"CASE WHEN o_custkey % 3 > 0 THEN {_N('7700000000 + o_custkey')} END",
    "kpp": f"CASE WHEN o_custkey % 3 > 0 THEN {_N('770000000 + c_nationkey')} END",
    "address": "CASE WHEN o_custkey % 5 > 0 THEN c_mktsegment || ', д. 5' END",
}
_LETTER = """'Генеральному директору ' || c_mktsegment || chr(10) || 'ООО "' || c_name || '"' || coalesce(' ИНН / КПП ' || inn || ' / ' || kpp, '') || chr(10)
  || coalesce('ул. ' || address, '') || chr(10) || 'Тел: +7 (495) ' || nr || '-12-34' || chr(10) || 'E-mail: c' || nr || '@example.ru' || chr(10) || sent || chr(10)
  || 'Просим провести ' || tests || ' испытания кабеля ' || cable || ' ' || cores || 'х' || section || ' по ТУ 16.К99-' || nr || '-2014, пункты 1.1.' || a || ', 1.2.' || b || ' и 1.6.' || a || '.'"""
_DIRECTION = """'НАПРАВЛЕНИЕ в испытательный центр' || chr(10) || 'Заказчик: Орган по сертификации ' || c_name || chr(10) || 'Изготовитель: Завод ' || c_mktsegment || ', г. Тула' || chr(10)
  || 'Марка ' || cable || ' ' || cores || 'х' || section || ' ГОСТ 7' || nr || '-97; марка ' || cable || ' ' || cores || 'х' || section || '; требование п. 4.' || a || '.' || b"""
_ACT = "'Акт отбора образцов. Дата ' || sent || '. Кабель ' || cable || ' отобран, стоимость согласована'"
_OTHER = "CASE WHEN o_custkey % 2 = 0 THEN 'Заявка принята, ответ будет дан позже: ' || c_name END"
#: Four kinds of documents in turn; of the last kind every other one has no text.
TEXT = f"CASE o_orderkey % 4 WHEN 0 THEN {_LETTER} WHEN 1 THEN {_DIRECTION} WHEN 2 THEN {_ACT} ELSE {_OTHER} END"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request document for each order: doc, text, and the columns of the order and its customer."""
    orders = table(spark, sf_dir, "orders")
    rows = spread(orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")), orders.count(), "o_orderkey")
    rows = rows.select("*", *[F.expr(sql).alias(name) for name, sql in PIECES.items()])
    return rows.select(F.col("o_orderkey").alias("doc"), "*", F.expr(TEXT).alias("text"))


_REQUESTS = f"""pieces AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in PIECES.items())} FROM orders JOIN customer ON o_custkey = c_custkey),
  requests AS (SELECT o_orderkey AS doc, *, {TEXT} AS text, cable || ' ' || cores || 'х' || section AS mark FROM pieces)"""


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT02 TXT03 TXT04 TXT06 CLS01: type, norm reference, clauses and designations of requests, the first with what stands around it."""
    t = F.col("text")
    join = lambda a: F.array_join(a, "|")
    sized = text.let(extract.sized_marks(t), lambda m: F.struct(join(m).alias("sized"), F.get(extract.with_context(t, F.slice(m, 1, 1)), F.lit(0))["context"].alias("context")))
    rows = requests(spark, sf_dir).select("doc", text.document_type(t).alias("kind"), F.coalesce(extract.norm_document(t), F.lit("-")).alias("norm"), join(extract.cited_clauses(t)).alias("clauses"), sized.alias("s"), join(extract.full_fire_marks(t)).alias("fire"))
    return rows.select("doc", "kind", "norm", "clauses", "s.sized", "fire", F.coalesce("s.context", F.lit("-")).alias("context"))


def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS01 CLS02 CLS03 CLS06: letter, direction, act or unknown, and the kind of tests that is asked for."""
    t = F.col("text")
    return requests(spark, sf_dir).select("doc", text.document_type(t).alias("kind"), text.test_type(t).alias("test_type"))


def letter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT17 TXT18 TXT19 TXT20: recipient, sender and contacts of letters, labelled parties of directions."""
    rows = requests(spark, sf_dir).filter("doc % 4 < 2").select("doc", "text", extract.letter(F.col("text")).alias("x"))
    blank = lambda c: F.coalesce(c, F.lit("-"))
    return rows.select("doc", *[blank(F.col(f"x.{c}")).alias(c) for c in ("recipient", "sender", "address", "inn", "kpp", "phone", "email")], "x.confidence", blank(extract.labelled(F.col("text"), "заказчик")).alias("customer"), blank(extract.labelled(F.col("text"), "изготовитель")).alias("manufacturer"))


_NAME = "CASE WHEN o_custkey % 11 = 0 THEN repeat('Очень длинное название ', 4) ELSE '' END || CASE c_nationkey % 4 WHEN 0 THEN 'Орган по сертификации ' WHEN 1 THEN 'Испытательный центр ' WHEN 2 THEN 'Дилер ' ELSE 'ООО ' END || c_name"
#: The two organisations that a request names: SQL over requests.
_PARTIES = [
    {"pos": "1", "name": _NAME, "role": "CASE WHEN o_orderkey % 2 = 0 THEN 'customer' ELSE 'unknown' END", "inn": "inn", "cents": "50 + 10 * (o_custkey % 5)"},
    {"pos": "2", "name": "'Кабельный завод ' || c_mktsegment", "role": "CASE WHEN o_custkey % 2 = 0 THEN 'manufacturer' ELSE 'unknown' END", "inn": "CAST(NULL AS STRING)", "cents": "55 + 10 * (o_orderkey % 4)"},
]


def _organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each request, from one reading of it."""
    party = lambda p: F.struct(*[F.expr(sql).alias(c) for c, sql in p.items()])
    rows = requests(spark, sf_dir).select("doc", "text", F.explode(F.array(*[party(p) for p in _PARTIES])).alias("p")).select("doc", "text", "p.*")
    return rows.withColumn("confidence", F.col("cents") / 100).withColumn("org_type", extract.organisation_type(F.lit(""), F.col("name")))


_PARTY = "parties AS (" + " UNION ALL ".join("SELECT doc, o_orderkey, c_nationkey, o_custkey, " + ", ".join(f"{sql} AS {c}" for c, sql in p.items()) + f", {'c_nationkey % 4' if p['pos'] == '1' else '4'} AS sort FROM requests" for p in _PARTIES) + ")"
_TYPES = "CASE sort WHEN 0 THEN 'certification_body' WHEN 1 THEN 'testing_center' WHEN 2 THEN 'dealer' WHEN 3 THEN 'unknown' ELSE 'manufacturer' END"


def organisation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS14 CLS15 FLT20 FLT21 WIN14: kinds and roles of the organisations of requests; every third request is a direction."""
    o = _organisations(spark, sf_dir).withColumn("direction", F.col("doc") % 3 == 0)
    return validate.roles(o, "doc", "pos", "direction").select("doc", "pos", "name", "role", "org_type")


#: Designations of an order's lines, good and bad ones, some in two spellings: SQL over lineitem and part.
_LINE = {
    "doc": "l_orderkey", "pos": "l_linenumber * CAST(10000000 AS BIGINT) + l_partkey",
    "mark": f"CASE p_size % 4 WHEN 0 THEN 'ВВГнг(А)-LS ' || {_N('p_size % 5 + 1')} || 'х2,5' WHEN 1 THEN 'ПВС ' || {_N('p_size')} || 'х1,5' WHEN 2 THEN p_name ELSE 'ввгнг(а)-ls  ' || {_N('p_size % 5 + 1')} || 'х2,5' END",
    "document": "CASE WHEN l_orderkey % 5 > 0 THEN 'ТУ 16.К99-058-2014' ELSE '' END", "ocr": "l_orderkey % 7 = 0",
}


def _checked_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return validate.marks(lines.select(*[F.expr(sql).alias(c) for c, sql in _LINE.items()]), "doc", "pos", "ocr")


_MARKS = f"""lines AS (SELECT {', '.join(f'{sql} AS {c}' for c, sql in _LINE.items())}, p_size % 4 IN (2, 3) AS bad FROM lineitem JOIN part ON l_partkey = p_partkey),
  again AS (SELECT *, row_number() OVER (PARTITION BY doc, CASE WHEN mark LIKE 'ввг%' THEN replace(replace(mark, 'ввгнг(а)-ls', 'ВВГнг(А)-LS'), '  ', ' ') ELSE mark END ORDER BY pos) > 1 AS again FROM lines),
  checked AS (SELECT *, round(greatest(greatest(CASE WHEN bad THEN least(CASE WHEN ocr THEN 0.75 * 0.85 ELSE 0.9 END, 0.4) ELSE CASE WHEN ocr THEN 0.75 * 0.85 ELSE 0.9 END END - CASE WHEN document = '' THEN 0.1 ELSE 0 END, 0) - CASE WHEN again THEN 0.05 ELSE 0 END, 0), 2) AS confidence,
  CASE WHEN bad THEN 'error' WHEN again OR document = '' THEN 'warning' ELSE 'ok' END AS status, concat_ws(',', CASE WHEN ocr THEN 'P1-1' END, CASE WHEN bad THEN 'P1-2' END, CASE WHEN document = '' THEN 'P1-3' END, CASE WHEN again THEN 'P2-1' END) AS warnings FROM again)"""


def mark_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS07 CLS10: confidence, status and warnings of each designation of an order's lines."""
    return _checked_marks(spark, sf_dir).select("doc", "pos", "confidence", "status", F.array_join("warnings", ",").alias("warnings"), "accepted")


def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS07 CLS10 CLS11 CLS12 AGG19: designations and organisations validated, one report for each request."""
    kinds = text.document_type(F.col("text")).alias("document_type")
    docs = requests(spark, sf_dir).select("doc", kinds, (F.coalesce(F.length("text"), F.lit(0)) + 200 * (F.col("o_custkey") % 3)).alias("n_chars"), (F.col("doc") % 7 == 0).alias("ocr"))
    orgs = _organisations(spark, sf_dir).withColumn("document_type", kinds)
    r = validate.reports(docs, _checked_marks(spark, sf_dir), validate.organisations(orgs, "document_type"), "doc")
    return r.select("doc", "n_marks", F.array_join("flags", ",").alias("flags"), "block_confirm", "overall_status", "overall_confidence")


#: Names that an operator entered for some requests: SQL over requests.
_EDIT = "CASE WHEN doc % 9 = 0 THEN 'Испытательный центр Юг' WHEN doc % 3 = 0 THEN 'Заказчик ' || c_name END"


def edited_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS13: reports after an operator's edits of customers, validated again."""
    kinds = text.document_type(F.col("text")).alias("document_type")
    r = requests(spark, sf_dir)
    docs = r.select("doc", kinds, F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), (F.col("doc") % 7 == 0).alias("ocr"))
    checked = validate.organisations(_organisations(spark, sf_dir).withColumn("document_type", kinds), "document_type")
    edited = validate.edited_customers(checked, r.select("doc", F.expr(_EDIT).alias("customer")), "doc", "pos", "document_type")
    out = validate.reports(docs, _checked_marks(spark, sf_dir), edited, "doc")
    return out.select("doc", F.array_join("flags", ",").alias("flags"), "block_confirm", "overall_status", "overall_confidence")


#: Cards of all customers and of the makers of each segment: SQL over customer.
_CARDS = f"SELECT c_custkey AS org_id, {_NAME.replace('o_custkey', 'c_custkey')} AS name FROM customer UNION ALL SELECT 1000000000 + min(c_custkey), 'ООО «Кабельный завод ' || c_mktsegment || '»' FROM customer GROUP BY c_mktsegment"
OWN_LABORATORY = ["завод-building"]


def extraction_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK02 SNK04 FLT20: a journal row for each request, with the cards of its customer and manufacturer, appended in two batches and read back."""
    c = table(spark, sf_dir, "customer")
    cards = c.selectExpr("c_custkey AS org_id", f"{_NAME.replace('o_custkey', 'c_custkey')} AS name").unionByName(c.groupBy("c_mktsegment").agg((1_000_000_000 + F.min("c_custkey")).alias("org_id")).selectExpr("org_id", "'ООО «Кабельный завод ' || c_mktsegment || '»' AS name"))
    r = requests(spark, sf_dir)
    given = r.filter("doc % 10 = 0").select("doc", F.when(F.col("doc") % 20 == 0, F.lit("заказчик")).alias("customer"), F.expr("'кабельный завод ' || c_mktsegment").alias("manufacturer"))
    found = journal.with_cards(journal.parties(_organisations(spark, sf_dir), "doc", "pos", OWN_LABORATORY, given), cards)
    rows = save(journal.entries(r, "doc", "text", text.document_type(F.col("text")), found, _checked_marks(spark, sf_dir).filter("accepted")))  # once for both batches
    work = folder(spark)
    for part in (0, 1):
        rows.filter(F.col("doc") % 2 == part).write.mode("append").parquet(work)
    return spark.read.schema(rows.schema).parquet(work)


#: Cells of an acceptance table: SQL over part. Every tenth row is a head, its columns in one of two orders.
_HEAD, _EMPTY = "p_partkey % 10 = 9", "p_partkey % 7 = 0"
_TITLE = "CASE p_partkey % 3 WHEN 0 THEN 'Проверка ' || p_name WHEN 1 THEN 'Маркировка ' || p_name ELSE 'Правила приемки ' || p_name END"
_CELLS = f"""CASE WHEN {_HEAD} AND p_size % 2 = 0 THEN array('Вид испытания', 'Требования', 'Метод') WHEN {_HEAD} THEN array('Метод', 'Наименование', 'Пункт', 'Примечание')
  ELSE concat(CASE p_size % 4 WHEN 0 THEN array('С' || p_size) WHEN 1 THEN array('p ' || p_size) WHEN 2 THEN array('т' || p_size) ELSE array() END,
  array({_TITLE}, CASE WHEN {_EMPTY} THEN '-' ELSE '2.' || p_size || '.1 - 2.' || p_size || '.' || (p_partkey % 4 + 1) END, CASE WHEN {_EMPTY} THEN '-' ELSE '5.' || p_size || '; 5.' || p_size END)) END"""


def acceptance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12 ARR05 CLS16 CLS17 CLS18: rows of an acceptance table; of a head the places of its columns."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CELLS).alias("cells")).select("p_partkey", "cells", extract.table_header(F.col("cells")).alias("is_head"), extract.acceptance_row(F.col("cells")).alias("r"))
    places = extract.column_places(F.col("cells"), {"name": "вид|наименование", "requirements": "требован|пункт", "methods": "метод"})
    blank = lambda c: F.coalesce(c, F.lit("-"))
    joined = lambda c: blank(F.array_join(c, "|"))
    at = F.when(F.col("is_head"), F.concat_ws(",", *[places[c].cast("string") for c in ("name", "requirements", "methods")])).otherwise("-")
    return rows.select("p_partkey", "is_head", at.alias("places"), blank("r.group_code").alias("group_code"), blank("r.category").alias("category"), blank("r.name").alias("name"), joined("r.requirements").alias("requirements"), joined("r.methods").alias("methods"), F.coalesce("r.billable", F.lit(False)).alias("billable"))


#: A norm's page for each part: a numbered line, a table row, a short line, and the first line again.
_PAGE = "'1.' || p_size || '.1 Сопротивление ' || p_name || '.' || chr(10) || 'С1 | Проверка ' || p_name || ' | 2.' || p_size || '.1 - 2.' || p_size || '.6 | 5.2' || chr(10) || 'коротко' || chr(10) || '1.' || p_size || '.1 Сопротивление ' || p_name || '.'"


def norm_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT05 SRC14: clauses with their titles from the lines of norms, the first of equal ones."""
    lines = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(F.expr(_PAGE), "\n")).alias("pos", "line"))
    c = lines.select("p_partkey", "pos", extract.clause_line(F.col("line")).alias("c")).filter("c is not null")
    return c.groupBy("p_partkey", "c.clause", "c.title").agg(F.min("pos").alias("pos"))


QUERIES = {f.__name__: f for f in (document_facts, document_type, letter_parse, organisation_roles, extraction_report, edited_reports, extraction_journal, mark_validation, acceptance_rows, norm_clauses)}
_KIND = "CASE doc % 4 WHEN 0 THEN 'letter' WHEN 1 THEN 'direction' WHEN 2 THEN 'act' ELSE 'unknown' END"
_FINAL = "CASE WHEN own THEN least(cents, 20) WHEN long THEN least(cents, 30) ELSE cents END"


def _report_sql(edited: str, more_chars: str, columns: str) -> str:
    return f"""WITH {_REQUESTS}, {_PARTY}, {_MARKS},
  o1 AS (SELECT *, length(name) > 80 AS long, role = 'customer' AND sort = 1 AS own, role = 'customer' AND inn IS NULL AND doc % 4 = 0 AS letter, role = 'customer' AND doc % 3 = 0 AS edited FROM parties),
  o2 AS (SELECT *, {_FINAL} AS c, ({_FINAL}) < 60 AND NOT (long OR own) AS unsure FROM o1),
  o3 AS (SELECT doc, role, letter, edited, greatest(c - CASE WHEN letter THEN 15 ELSE 0 END, 0) AS final, CASE WHEN long OR own THEN 2 WHEN unsure OR letter THEN 1 ELSE 0 END AS level, long OR own AS p0 FROM o2),
  o4 AS ({edited}),
  o AS (SELECT doc, max(CASE WHEN role <> 'unknown' THEN level END) AS worst, max(CASE WHEN role = 'customer' THEN final END) AS best, bool_or(role = 'customer' AND p0) AS bad FROM o4 GROUP BY doc),
  m AS (SELECT doc, count(*) AS n_marks, max(CASE status WHEN 'warning' THEN 1 WHEN 'ok' THEN 0 END) AS worst, sum(CASE WHEN NOT bad THEN CAST(round(confidence * 100) AS BIGINT) END) AS cents, count(*) FILTER (WHERE NOT bad) AS n FROM checked GROUP BY doc),
  j AS (SELECT doc, doc % 4 = 3 AS unknown, doc % 7 = 0 AS ocr, coalesce(n_marks, 0) AS n_marks, coalesce(n_marks, 0) = 0 AND coalesce(length(text), 0){more_chars} > 500 AS none, coalesce(o.bad, false) AS bad,
  greatest(coalesce(m.worst, 0), coalesce(o.worst, 0)) AS worst, coalesce(m.cents, 0) + coalesce(best, 0) AS cents, coalesce(n, 0) + CASE WHEN best IS NULL THEN 0 ELSE 1 END AS n FROM requests LEFT JOIN m USING (doc) LEFT JOIN o USING (doc)),
  k AS (SELECT *, CASE WHEN n > 0 THEN CAST((2 * cents + n) // (2 * n) AS BIGINT) ELSE 0 END AS mean FROM j),
  r AS (SELECT doc, n_marks, concat_ws(',', CASE WHEN ocr THEN 'P1-1' END, CASE WHEN unknown THEN 'P2-2' END, CASE WHEN none THEN 'P0-2' END, CASE WHEN bad THEN 'P0-1' END) AS flags, none OR bad AS block_confirm,
  CASE WHEN worst = 2 THEN 'error' WHEN worst = 1 OR unknown THEN 'warning' ELSE 'ok' END AS overall_status, CASE WHEN unknown AND worst = 0 THEN greatest(mean - 10, 0) ELSE mean END / 100.0::DOUBLE AS overall_confidence FROM k)
  SELECT {columns} FROM r"""


SQL: dict[str, str] = {
    "document_facts": f"""WITH {_REQUESTS}, f AS (SELECT doc, text, mark, {_KIND} AS kind,
  CASE doc % 4 WHEN 0 THEN 'ТУ 16.К99-' || nr || '-2014' WHEN 1 THEN 'ГОСТ 7' || nr || '-97' ELSE '-' END AS norm,
  CASE doc % 4 WHEN 0 THEN '1.1.' || a || '|1.2.' || b || '|1.6.' || a WHEN 1 THEN '4.' || a || '.' || b ELSE '' END AS clauses,
  CASE WHEN doc % 4 < 2 THEN mark ELSE '' END AS sized, CASE WHEN doc % 4 < 3 AND cable <> 'ПВС' THEN cable ELSE '' END AS fire FROM requests)
  SELECT doc, kind, norm, clauses, sized, fire, CASE WHEN sized = '' THEN '-' ELSE trim(regexp_replace(substr(text, greatest(instr(text, mark) - 160, 1), least(instr(text, mark) - 1, 160) + length(mark) + 160), '\\s+', ' ', 'g')) END AS context FROM f""",
    "document_type": f"WITH {_REQUESTS} SELECT doc, {_KIND} AS kind, CASE doc % 4 WHEN 0 THEN tests WHEN 1 THEN 'сертификационные' ELSE 'периодические' END AS test_type FROM requests",
    "letter_parse": f"""WITH {_REQUESTS} SELECT doc, CASE doc % 4 WHEN 0 THEN c_mktsegment ELSE '-' END AS recipient, CASE doc % 4 WHEN 0 THEN c_name ELSE '-' END AS sender,
  CASE doc % 4 WHEN 0 THEN coalesce(address, '-') ELSE '-' END AS address, CASE doc % 4 WHEN 0 THEN coalesce(inn, '-') ELSE '-' END AS inn, CASE doc % 4 WHEN 0 THEN coalesce(kpp, '-') ELSE '-' END AS kpp,
  CASE doc % 4 WHEN 0 THEN '+7 (495) ' || nr || '-12-34' ELSE '-' END AS phone, CASE doc % 4 WHEN 0 THEN 'c' || nr || '@example.ru' ELSE '-' END AS email,
  CAST(CASE WHEN doc % 4 = 1 THEN 0.55 WHEN inn IS NULL AND address IS NULL THEN 0.75 WHEN address IS NULL THEN 0.85 WHEN inn IS NULL THEN 0.9 ELSE 0.95 END AS DOUBLE) AS confidence,
  CASE doc % 4 WHEN 1 THEN 'Орган по сертификации ' || c_name ELSE '-' END AS customer, CASE doc % 4 WHEN 1 THEN 'Завод ' || c_mktsegment ELSE '-' END AS manufacturer FROM requests WHERE doc % 4 < 2""",
    "organisation_roles": f"""WITH {_REQUESTS}, {_PARTY}, r AS (SELECT doc, pos, name, {_TYPES} AS org_type, CASE WHEN sort = 0 AND doc % 3 = 0 THEN 'customer' WHEN sort = 1 THEN 'unknown' ELSE role END AS role FROM parties)
  SELECT doc, pos, name, role, org_type FROM r UNION ALL SELECT doc, pos, name, 'customer', org_type FROM r WHERE pos = 2 AND doc % 3 = 0 AND doc NOT IN (SELECT doc FROM r WHERE role = 'customer')""",
    "mark_validation": f"WITH {_MARKS} SELECT doc, pos, CAST(confidence AS DOUBLE) AS confidence, status, warnings, NOT bad AS accepted FROM checked",
    "extraction_report": _report_sql("SELECT * FROM o3", " + 200 * (o_custkey % 3)", "doc, n_marks, flags, block_confirm, overall_status, overall_confidence"),
    "edited_reports": _report_sql("""SELECT doc, role, CASE WHEN edited AND doc % 9 > 0 THEN greatest(final, 75) WHEN edited THEN greatest(least(final, 20) - CASE WHEN letter THEN 15 ELSE 0 END, 0) ELSE final END AS final,
  CASE WHEN edited AND doc % 9 > 0 THEN 0 WHEN edited THEN 2 ELSE level END AS level, CASE WHEN edited THEN doc % 9 = 0 ELSE p0 END AS p0 FROM o3""", "", "doc, flags, block_confirm, overall_status, overall_confidence"),
    "extraction_journal": f"""WITH {_REQUESTS}, {_PARTY}, {_MARKS}, makers AS (SELECT c_mktsegment AS segment, 1000000000 + min(c_custkey) AS maker FROM customer GROUP BY 1), m AS (SELECT doc, count(*) AS n FROM checked WHERE NOT bad GROUP BY doc)
  SELECT doc, {_KIND} AS source_type, CASE WHEN doc % 2 = 0 OR c_nationkey % 4 = 0 THEN o_custkey END AS customer_org_id, CASE WHEN (o_custkey % 2 = 0 OR doc % 10 = 0) AND c_mktsegment <> 'BUILDING' THEN maker END AS manufacturer_org_id,
  coalesce(length(text), 0) AS raw_text_length, coalesce(n, 0) AS marks_count FROM requests JOIN makers ON segment = c_mktsegment LEFT JOIN m USING (doc)""",
    "acceptance_rows": f"""WITH p AS (SELECT *, {_HEAD} AS is_head, NOT ({_HEAD}) AND NOT ({_EMPTY}) AND p_partkey % 3 < 2 AS good, {_TITLE} AS title FROM part)
  SELECT p_partkey, is_head, CASE WHEN is_head AND p_size % 2 = 0 THEN '0,1,2' WHEN is_head THEN '1,2,0' ELSE '-' END AS places, CASE WHEN good AND p_size % 4 < 3 THEN (['С', 'П', 'Т'])[p_size % 4 + 1] || p_size ELSE '-' END AS group_code,
  CASE WHEN good AND p_size % 4 < 3 THEN (['psi', 'periodic', 'type'])[p_size % 4 + 1] ELSE '-' END AS category, CASE WHEN good THEN title ELSE '-' END AS name,
  CASE WHEN good THEN array_to_string(['2.' || p_size || '.' || i FOR i IN range(1, p_partkey % 4 + 2)], '|') ELSE '-' END AS requirements, CASE WHEN good THEN '5.' || p_size ELSE '-' END AS methods, good AND p_partkey % 3 = 0 AS billable FROM p""",
    "norm_clauses": "SELECT p_partkey, '1.' || p_size || '.1' AS clause, 'Сопротивление ' || p_name AS title, 0 AS pos FROM part UNION ALL SELECT p_partkey, '2.' || p_size || '.1', 'Проверка ' || p_name, 1 FROM part",
}

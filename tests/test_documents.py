"""Facts of single documents whose answers are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlake.functions import extract, marks, text
from ordlake.operators import match, validate
from ordlake.sources import files

LETTER = 'Генеральному директору Центра испытаний\nООО "Ромашка" ИНН / КПП 7701234567 / 770101001\nул. Мира, д. 5, Москва\nТел: +7 (495) 123-45-67\nE-mail: info@romashka.ru\n01.02.2026\nПросим провести периодические испытания кабеля ВВГнг(А)-LS 3х2,5 по ТУ 16.К99-058-2014, пункты 1.1.3, 1.2.1 и 1.6.6.'
DIRECTION = "НАПРАВЛЕНИЕ в испытательный центр\nЗаказчик: Орган по сертификации «Знак»\nИзготовитель: Кабельный завод Восток, г. Тула\nМарка ПВС 3х1,5 ГОСТ 7399-97; марка ПВС 3х1,5; требование п. 4.5.7"
ACT = "Акт отбора образцов. Дата 12.07.2026. Кабель КПСнг(А)-FRLS отобран, стоимость согласована"


def each(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}").select("i", f(F.col("x")).alias("c")).orderBy("i").collect()
    return [r.c for r in rows]


def test_facts(spark):
    docs = [LETTER, DIRECTION, ACT, None]
    assert each(spark, text.document_type, docs) == ["letter", "direction", "act", "unknown"]
    assert each(spark, extract.norm_document, docs) == ["ТУ 16.К99-058-2014", "ГОСТ 7399-97", None, None]
    assert each(spark, extract.cited_clauses, docs) == [["1.1.3", "1.2.1", "1.6.6"], ["4.5.7"], [], []]
    assert each(spark, extract.sized_marks, docs) == [["ВВГнг(А)-LS 3х2,5"], ["ПВС 3х1,5"], [], []]
    assert each(spark, extract.full_fire_marks, docs) == [["ВВГнг(А)-LS"], [], ["КПСнг(А)-FRLS"], []]
    assert each(spark, lambda x: extract.labelled(x, "изготовитель"), docs) == [None, "Кабельный завод Восток", None, None]
    a = each(spark, extract.letter, docs)[0]
    assert tuple(a) == ("Центра испытаний", "Ромашка", "Мира, д. 5, Москва", "7701234567", "770101001", "+7 (495) 123-45-67", "info@romashka.ru", 0.95)


def test_document_type(spark):
    rows = {"Генеральному директору. Просим Вас провести испытания кабеля в 2026 году": "letter", "короткий текст": "unknown", "Просто длинный текст без признаков документа какого-либо вида": "unknown", "уважаемый коллега! просим в срок провести периодические испытания": "letter"}
    assert each(spark, text.document_type, list(rows)) == list(rows.values())


def test_clauses(spark):
    rows = {"2.3.1 - 2.3.3": ["2.3.1", "2.3.2", "2.3.3"], "1.2, 1.4; 1.2": ["1.2", "1.4"], "4.1-4.3, 5": ["4.1", "4.2", "4.3", "5"], "7.9 - 7.2": ["7.9 - 7.2"], "1.1 - 1.99": ["1.1 - 1.99"], "": []}
    assert each(spark, text.clauses, list(rows)) == list(rows.values())


def test_acceptance_row(spark):
    rows = [["С1", "Проверка конструкции", "2.3.1 - 2.3.3", "5.2.1"], ["p2", "Маркировка и упаковка", "1.2.1", "4.1"], ["Вид испытания", "Требования", "Метод"], ["т3", "Удар", "-", "-"], []]
    got = each(spark, extract.acceptance_row, rows, "array<string>")
    assert [r and (r.group_code, r.category, r.requirements, r.methods, r.billable) for r in got] == [("С1", "psi", ["2.3.1", "2.3.2", "2.3.3"], ["5.2.1"], True), ("П2", "periodic", ["1.2.1"], ["4.1"], False), None, None, None]
    assert each(spark, extract.table_header, rows, "array<string>") == [False, False, True, False, False]


def test_marks(spark):
    spellings = ["ВВГнг(A)-LS  3х2,5", "КПСнг 2 X 2х0,5", "ПВС 3*1,5", "кабель", None]
    parsed = each(spark, marks.parse_mark, spellings)
    assert [(r.cores, r.groups, r.size, r.is_lan) for r in parsed[:4]] == [(3, 1, 2.5, False), (4, 2, 0.5, True), (1, 1, 1.0, False), (1, 1, 1.0, False)]
    assert each(spark, text.mark_key, spellings) == ["ввгнг(a)-ls3x2.5", "кпснг2x2x0.5", "пвс3*1.5", "кабель", ""]


def test_organisation_key(spark):
    rows = {'ООО "Ромашка"': "ромашка", "ооо ромашка": "ромашка", "ПАО «Завод, №1»": "завод, №1", "Customer Ltd.": "customer ltd", "": ""}
    assert each(spark, text.organisation_key, list(rows)) == list(rows.values())
    assert each(spark, extract.placeholder, ["Заказчик", "i.petrov", "Ромашка", "", None]) == [True, True, False, True, True]


def test_jammed(spark):
    rows = {"Проверка конструкции Проверка маркировки": ["Проверка конструкции", "Проверка маркировки"], "Измерение длины": ["Измерение длины"], "Стойкость к удару Испытание напряжением": ["Стойкость к удару", "Испытание напряжением"]}
    assert each(spark, text.jammed, list(rows)) == list(rows.values())


def test_ocr_words(spark):
    tsv = "5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t96.5\tВВГ\n5\t1\t1\t1\t1\t2\t10\t20\t30\t40\t-1\t\n5\t1\t1\t1\t1\t3\t50\t20\t30\t40\t83.5\t3х2,5"
    assert [[(w.text, w.conf) for w in r] for r in each(spark, files.ocr_words, [tsv, ""])] == [[("ВВГ", 96.5), ("3х2,5", 83.5)], []]


def test_lexicon_prefers_long_names(spark):
    names = spark.createDataFrame([("КГ",), ("кгвв",), ("КГ  ",), ("",), (None,), ("ПВС 2",), ("ПВС",), ("a.b",)], "n string")
    pattern = match.lexicon(names, "n")
    texts = ["кабель КГВВ и КГ, также ПВС 2", "КПСнг и кг", "axb a.b", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").join(pattern)
    got = df.select("i", F.regexp_extract_all("t", F.col("pattern"), F.lit(1)).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [["КГВВ", "КГ", "ПВС 2"], ["кг"], ["a.b"], [], None]


def test_roles_and_reports(spark):
    orgs = spark.createDataFrame([(1, 1, "Орган по сертификации «Знак»", "unknown", 0.8), (1, 2, "Кабельный завод Восток", "manufacturer", 0.7), (2, 1, "Испытательный центр Север", "customer", 0.9), (2, 2, "Завод Запад", "unknown", 0.5), (3, 1, "ООО Дилер", "customer", 0.9)], "doc int, pos int, name string, role string, confidence double")
    typed = orgs.withColumn("org_type", extract.organisation_type(F.lit(""), F.col("name"))).withColumn("direction", F.col("doc") < 3)
    got = validate.roles(typed, "doc", "pos", "direction").select("doc", "pos", "role", "org_type").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "customer", "certification_body"), (1, 2, "manufacturer", "manufacturer"), (2, 1, "unknown", "testing_center"), (2, 2, "customer", "manufacturer"), (2, 2, "unknown", "manufacturer"), (3, 1, "customer", "dealer")]
    found = spark.createDataFrame([(1, 1, "ВВГнг(А)-LS 3х2,5", "ТУ", False), (1, 2, "ввгнг(а)-ls  3х2,5", "ТУ", False), (1, 3, "ВВГнг(А)-LS  3х2,5", "", False), (2, 1, "ПВС 3х1,5", "ГОСТ", True), (3, 1, "просто слова", None, False)], "doc int, pos int, mark string, document string, ocr boolean")
    checked = validate.marks(found, "doc", "pos", "ocr")
    assert sorted((r.doc, r.pos, r.confidence, r.status, ",".join(r.warnings)) for r in checked.collect()) == [(1, 1, 0.9, "ok", ""), (1, 2, 0.35, "error", "P1-2,P2-1"), (1, 3, 0.75, "warning", "P1-3,P2-1"), (2, 1, 0.64, "ok", "P1-1"), (3, 1, 0.3, "error", "P1-2,P1-3")]
    docs = spark.createDataFrame([(1, "letter", 900, False), (2, "direction", 300, True), (3, "unknown", 200, False), (4, "unknown", 5000, False)], "doc int, document_type string, n_chars int, ocr boolean")
    parties = orgs.withColumn("org_type", F.lit("unknown")).withColumn("inn", F.lit(None).cast("string")).join(docs.select("doc", "document_type"), "doc")
    r = validate.reports(docs, checked, validate.organisations(parties, "document_type"), "doc").orderBy("doc").collect()
    assert [(x.n_marks, ",".join(x.flags), x.block_confirm, x.overall_status, x.overall_confidence) for x in r] == [(3, "", False, "warning", 0.83), (1, "P1-1,P0-1", True, "error", 0.42), (1, "P2-2", False, "warning", 0.8), (0, "P2-2,P0-2", True, "warning", 0.0)]


def test_customer_hint(spark):
    rows = {
        "/srv/SUPR/2026/письмо.pdf": "SUPR", "C:\\Users\\i.ivanov\\АНО Центр\\2026\\ВВГ 3х2\\a.docx": "АНО Центр", "inbox/ООО ВВГ 3х2/a.pdf": "ООО ВВГ 3х2",
        "Каменск/2025/a.pdf": "Каменск", "C:/temp/2026/a.pdf": "", "a.pdf": "", "i.ivanov/a.pdf": "", "share$/кабельный/AB/a.pdf": "кабельный", "": "",
    }
    assert each(spark, extract.customer_hint, [*rows, None]) == [*rows.values(), ""]


def test_document_and_clause(spark):
    rows = {
        "ТУ 16.К99-058–2014 (1.4.1)": ("ТУ 16.К99-058-2014", "1.4.1"), "п. 2.3, ТУ 3581-001": ("ТУ 3581-001", "п. 2.3"), "ТУ 27": ("ТУ 27", "ТУ 27"),
        "1.3.3 ÷ 1.3.11": ("общий", "1.3.3 - 1.3.11"), "табл. 4": ("общий", "табл. 4"), "по чертежу": ("общий", "по чертежу"), "СТУ 5": ("общий", "СТУ 5"), "": ("общий", ""),
    }
    got = each(spark, lambda x: extract.document_and_clause(x, "общий"), [*rows, None])
    assert [tuple(r) for r in got] == [*rows.values(), ("общий", "")]
    assert each(spark, extract.clause_tokens, ["1.3.3 1.3.11", "4.2.2; п. 4.2÷4.3,", "", None]) == [["1.3.3", "1.3.11"], ["4.2.2", "4.2-4.3"], [], []]

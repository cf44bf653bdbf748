from __future__ import annotations

from pyspark.sql import functions as F

from ordlake.functions import extract


def test_cited_clauses(spark):
    rows = {
        "по п. 5.2.1 и п.5.2.3": ["5.2.1", "5.2.3"],
        "пункты 1.2, 1.3; 1.4 и 1.5": ["1.2", "1.3", "1.4", "1.5"],
        "Требования: 2.1.1, 2.1.2": ["2.1.1"],
        "метод п. 3.4 и 3.5": ["3.4", "3.5"],
        "проверка — 7.1.2": ["7.1.2"],
        "п. 12.05.2024": [],
        "пп 1.1": ["1.1"],
        "раздел 4.4": [],
        "": [],
    }
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", extract.cited_clauses(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == rows


def test_clause_line(spark):
    rows = {
        "1.4.1 Проверка изоляции": ("1.4.1", "Проверка изоляции"),
        "С1 | Проверка конструкции | 2.3.1 - 2.3.6 |": ("2.3.1", "Проверка конструкции"),
        "1.4.1 мало": None,
        "два слова | Проверка конструкции | 2.3.1 |": None,
        "С1 | Проверка конструкции | 2.3.1": None,
        "просто строка текста": None,
    }
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", extract.clause_line(F.col("t")).alias("c")).collect()
    assert {r.t: tuple(r.c) if r.c else None for r in got} == rows


def column_of(spark, f, texts):
    return [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("c")).orderBy("i").collect()]


def test_norm_document(spark):
    rows = {"по ТУ 16.К99-058-2014 и ГОСТ 7399-97": "ТУ 16.К99-058-2014", "Ty 16.K71-310-2001.": "ТУ 16.К71-310-2001", "ГОСТ 31565-2012, ТУ 3581": "ГОСТ 31565-2012", "Р МЭК 60332 - 1": "Р МЭК 60332-1", "ТУ 27.32.13-001": "ТУ 27.32.13-001", "ТУ 16": None, "без ссылок": None, "": None, "ГОСТ": None}
    assert column_of(spark, extract.norm_document, list(rows)) == list(rows.values())


def test_full_fire_marks(spark):
    rows = {"кабель ВВГнг(А)-LS 3х2,5, ВВГнг ( A )-LS; КПСнг(А)-FRLS.": ["ВВГнг(А)-LS", "КПСнг(А)-FRLS"], "КСБнг(А)-FRHF-ХЛ": ["КСБнг(А)-FRHF-ХЛ"], "ВВГнг(В)-LS ВВГнг(А) нг(А)-LS ВВГнг(А)-XX": [], "": []}
    assert column_of(spark, extract.full_fire_marks, list(rows)) == list(rows.values())


def test_letter(spark):
    text = 'Генеральному директору Центра\nООО "Ромашка" ИНН / КПП 7701234567 / 770101001\nул. Мира, д. 5, Москва\nE-mail: a@b.ru\n01.02.2026\nООО "Другая"'
    a, b = column_of(spark, extract.letter, [text, None])
    assert (a.sender, a.address, a.inn, a.kpp, a.email, a.confidence) == ("Ромашка", "Мира, д. 5, Москва", "7701234567", "770101001", "a@b.ru", 0.95)
    assert (b.sender, b.phone, b.recipient, b.confidence) == (None, None, None, 0.55)

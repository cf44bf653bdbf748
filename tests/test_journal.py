from __future__ import annotations

from pyspark.sql import functions as F

from ordlake.operators import journal, quality, validate

ORGS = "doc int, pos int, name string, role string, org_type string"


def test_parties(spark):
    orgs = spark.createDataFrame([
        (1, 1, "НИЦ Своя-лаборатория", "customer", "testing_center"), (1, 2, "Орган по сертификации", "unknown", "certification_body"), (1, 3, "ООО Ромашка", "customer", "unknown"), (1, 4, "Завод", "manufacturer", "manufacturer"),
        (2, 1, "Заказчик", "customer", "unknown"), (2, 2, None, "manufacturer", "unknown"), (2, 3, "Б", "customer", "unknown"), (2, 3, "А", "customer", "unknown"),
        (3, 1, "Завод", "manufacturer", "manufacturer"),
    ], ORGS)
    given = spark.createDataFrame([(1, "customer", " Другой завод "), (3, "Новый", "своя лаборатория"), (4, "Только", None)], "doc int, customer string, manufacturer string")
    own = ["Своя лаборатория", ""]
    plain = journal.parties(orgs, "doc", "pos", own).collect()
    assert sorted(map(tuple, plain)) == [(1, "Орган по сертификации", "Завод"), (2, "А", None), (3, None, "Завод")]
    asked = journal.parties(orgs, "doc", "pos", own, given)
    assert sorted(map(tuple, asked.collect())) == [(1, "Орган по сертификации", "Другой завод"), (2, "А", None), (3, "Новый", "Завод"), (4, "Только", None)]
    cards = spark.createDataFrame([(9, "ООО «НОВЫЙ»"), (5, "новый"), (7, "завод"), (8, ""), (6, None)], "org_id long, name string")
    got = {r.doc: (r.customer_org_id, r.manufacturer_org_id) for r in journal.with_cards(asked, cards).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (5, 7), 4: (None, None)}
    docs = spark.createDataFrame([(1, "abc"), (5, None)], "doc int, text string")
    marks = spark.createDataFrame([(1,), (1,), (7,)], "doc int")
    rows = journal.entries(docs, "doc", "text", F.lit("letter"), journal.with_cards(asked, cards), marks)
    assert rows.columns == journal.JOURNAL and sorted(map(tuple, rows.collect())) == [(1, "letter", None, None, 3, 2), (5, "letter", None, None, 0, 0)]
    assert journal.parties(orgs.filter("false"), "doc", "pos", []).count() == 0


def test_labels(spark):
    documents = spark.createDataFrame([(1, "a/15.txt"), (2, "b/5.txt"), (3, "c/5.TXT"), (4, "x.pdf"), (5, None), (6, "")], "document_id long, path string")
    labels = spark.createDataFrame([
        (1, "4", "q/5.txt", None), (2, "99", "q\\5.txt", None), (3, None, None, "l/15.txt.json"), (4, "x", "z/X.PDF", "l/5.txt.json"), (5, None, ".txt", "none"),
        (6, None, "nothing", "nothing.json"), (7, None, None, None), (8, " 2 ", None, None), (9, "9" * 30, "", "5.txt"), (10, None, None, "pdf.json"),
    ], "label_id long, document_id string, source_file string, label_file string")
    got = {r.label_id: (r.document_id, r.found_by) for r in journal.resolve_labels(labels, documents).collect()}
    assert got == {1: (4, "id"), 2: (3, "name"), 3: (1, "name"), 4: (4, "name"), 5: (3, "path"), 6: (None, None), 7: (None, None), 8: (2, "id"), 9: (3, "name"), 10: (4, "path")}
    assert journal.resolve_labels(labels, documents.filter("false")).filter("document_id IS NOT NULL").count() == 0


def test_edited_customers(spark):
    orgs = spark.createDataFrame([
        (1, 1, "Старый", "customer", "unknown", 0.5, "letter"), (1, 2, "Второй", "customer", "unknown", 0.5, "letter"), (2, 1, "Старый", "customer", "unknown", 0.9, "letter"),
        (3, 1, "Завод", "manufacturer", "manufacturer", 0.9, "act"), (4, 1, "Старый", "customer", "unknown", 0.8, "act"), (5, 1, "Старый", "customer", "unknown", 0.8, "act"),
    ], "doc int, pos int, name string, role string, org_type string, confidence double, kind string").withColumn("inn", F.lit(None).cast("string"))
    checked = validate.organisations(orgs, "kind")
    edits = spark.createDataFrame([(1, " Новый "), (2, "Испытательный центр"), (3, "Новый"), (4, None), (9, "Чужой")], "doc int, customer string")
    got = {(r.doc, r.pos): (r.name, r.confidence, r.status, ",".join(r.warnings)) for r in validate.edited_customers(checked, edits, "doc", "pos", "kind").collect()}
    assert got == {
        (1, 1): ("Новый", 0.75, "ok", ""), (1, 2): ("Второй", 0.35, "warning", "P1-4,P1-5"), (2, 1): ("Испытательный центр", 0.05, "error", "P0-1,P1-5"),
        (3, 1): ("Завод", 0.9, "ok", ""), (4, 1): ("Старый", 0.8, "ok", ""), (5, 1): ("Старый", 0.8, "ok", ""),
    }


def test_runs(spark):
    a = spark.createDataFrame([(1, 3, 0.5), (2, 3, 0.5), (3, 3, 0.5), (4, 1, 0.1)], "k int, marks int, q double")
    b = spark.createDataFrame([(1, 5, 0.52), (2, 5, 0.53), (3, 1, 0.4), (5, 1, 0.1)], "k int, marks int, q double")
    got = quality.compare_runs(a, b, "k", ["marks"], "q").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0.02, "tie"), (2, 2, 0.03, "B"), (3, -2, -0.1, "A"), (4, None, None, None), (5, None, None, None)]

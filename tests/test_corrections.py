from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ordlake.functions.marks import after_ocr
from ordlake.operators import correct, merge
from ordlake.sources import files

CATALOGUE = ["ВВГнг(А)-LS 3х2,5", "ВВГнг(А)-LS 13х2,5", "КПСнг(А)-FRLS 2х2х0,5", "ПВС 3х1,5", "ПВС 3х2,5", " ", None]
TYPED = ["ВВГнг(А)-LS 3х2,5", "BBГнг(A)-LS 3х2,5", "ВВГнг(А)-L 3х2,5", "BBГнг(A)-L 3х2,5", "ПВС 3х1.5", "  ПВС 3х2,5 ", "кабель", "ПВСм 3х1,5", "КПСнг(А)-FRLS 2х2х0,50", "", "  ", None, "КПСнг(А)-FRLS 2х2х0,5" * 40]


def alike(x):
    return "".join(x.lower().split()).replace("×", "х").replace("x", "х").replace("ё", "е")


def test_marks_equal_all_pairs(spark):
    df = spark.createDataFrame(list(enumerate(TYPED + TYPED[:3])), "i int, t string")
    names = spark.createDataFrame([(n,) for n in CATALOGUE], "t string")
    spelled = {r.i: r.s for r in df.select("i", after_ocr(F.trim(F.coalesce("t", F.lit("")))).alias("s")).collect()}
    known = [n.strip() for n in CATALOGUE if n and n.strip()]
    want = {}
    for i, t in enumerate(TYPED + TYPED[:3]):
        raw, s = (t or "").strip(), spelled[i]
        if not raw:
            want[i] = (t or "", 0.0, "deterministic", "empty")
            continue
        best = min((-round(SequenceMatcher(None, alike(s), alike(n)).ratio(), 6), len(n), n) for n in known if n[:3] == s[:3] or n[:2] == s[:2]) if any(n[:2] == s[:2] for n in known) else (0, 0, s)
        close, score = (best[2], -best[0]) if -best[0] >= 0.86 and best[2] != s else (None, 0)
        if s != raw:
            want[i] = (close, min(0.93, 0.75 + score * 0.2), "brand_db", "spelling and close") if close else (s, 0.88, "brand_db", "spelling")
        else:
            want[i] = (close, min(0.92, 0.7 + score * 0.25), "brand_db", "close") if close else (s, 0.95, "deterministic", "unchanged")
    got = {r.i: r for r in correct.marks(df, "i", "t", names, "t").collect()}
    assert set(got) == set(want)
    for i, (suggested, sure, source, reason) in want.items():
        assert (got[i].suggested, got[i].source, got[i].reason) == (suggested, source, reason)
        assert got[i].confidence == pytest.approx(sure)
    assert {r.reason for r in got.values()} == {"empty", "unchanged", "spelling", "close", "spelling and close"}


def test_marks_without_a_catalogue(spark):
    df = spark.createDataFrame([(1, "BBГнг(A)-LS 3х2,5"), (2, "ПВС 3х1,5")], "i int, t string")
    got = correct.marks(df, "i", "t", df.filter("false"), "t").orderBy("i").collect()
    assert [(r.suggested, r.confidence, r.source) for r in got] == [("ВВГнг(А)-LS 3х2,5", 0.88, "deterministic"), ("ПВС 3х1,5", 0.95, "deterministic")]
    assert correct.marks(df.filter("false"), "i", "t", df, "t").count() == 0


def test_synonyms(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"synonyms": [{"phrase": "Изгиб", "canonical_code": "bend", "confidence": 0.8}, {"phrase": "изгиб и удар", "canonical_code": "both"}, {"phrase": "удар", "canonical_code": "hit", "confidence": 0.8}, {"phrase": "", "canonical_code": "no"}, {"phrase": "x"}], "code_aliases": {"bend": "изгиб_код"}}')
    (tmp_path / "b.json").write_text('{"other": 1}')
    synonyms, aliases = files.synonyms(spark, str(tmp_path))
    texts = spark.createDataFrame([(1, " Стойкость к ИЗГИБ и удар"), (2, "из"), (3, ""), (4, None), (5, "масса"), (6, "удары")], "i int, t string")
    got = correct.canonical_codes(correct.resolve_synonym(texts, "i", "t", synonyms), "code", aliases)
    assert sorted(map(tuple, got.collect())) == [(1, "изгиб_код", 0.8), (2, "изгиб_код", 0.8), (6, "hit", 0.8)]


CARD = "org_id long, name string, inn string, org_type string, accredited boolean, phone string"


def test_organisation_cards(spark):
    old = spark.createDataFrame([(1, 'ООО "Ромашка"', "77", "dealer", False, None), (2, "Ромашка", "", "unknown", True, "2-2"), (3, "Лютик", None, "unknown", False, "3-3"), (4, "Мак", "78", "unknown", False, "4")], CARD)
    new = [
        (10, "Ромашка Плюс", " 77 ", "unknown", True, None), (11, "ромашка", "77", "manufacturer", False, None),  # both meet card 1; the last name is that of card 2
        (12, "ООО Лютик", None, "dealer", False, "5-5"), (13, "Мак", "", "unknown", False, "9"), (14, "Мак", None, "dealer", False, None),  # card 3 by name; no card 'Мак' without a tax id: a new one
        (15, "Заказчик", "79", "unknown", False, None), (16, "Астра", "80", "unknown", False, "1"), (17, "Астра Два", "80", "unknown", True, None),
    ]
    found = spark.createDataFrame(new, CARD.replace("org_id", "position"))
    cards, moved = merge.upsert_organisations(old, found, ["phone"])
    assert sorted(map(tuple, cards.collect())) == [
        (1, "ромашка", "77", "manufacturer", True, "2-2"), (3, "ООО Лютик", None, "dealer", False, "5-5"), (4, "Мак", "78", "unknown", False, "4"),
        (18, "Мак", None, "dealer", False, "9"), (21, "Астра Два", "80", "unknown", True, "1"),
    ]
    assert list(map(tuple, moved.collect())) == [(2, 1)]
    again, _ = merge.upsert_organisations(old, found.filter("false"), ["phone"])
    assert sorted(r.org_id for r in again.collect()) == [1, 2, 3, 4]
    assert sorted(r.org_id for r in merge.upsert_organisations(old.filter("false"), found.filter("position = 16"), ["phone"])[0].collect()) == [16]

"""The journal normalises each name before its join, sorts no designations for what it does not read, and spreads rows without a name."""

from __future__ import annotations

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from ordlake import rules
from ordlake.functions import extract
from ordlake.functions.text import organisation_key
from ordlake.operators import journal, validate
from ordlake.plans import extraction

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def shuffled(spark):
    """Joins are planned as for large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    yield
    spark.conf.unset(key)


def test_cards_are_met_by_keys_that_are_columns(spark, shuffled):
    names = ["ООО Ромашка", "ромашка", None, "", " . ", "Завод", "нет такого", "«»"]
    found = spark.createDataFrame([(i % 5, names[i % 8], names[i // 8 % 8]) for i in range(64)], "doc int, customer string, manufacturer string")
    cards = spark.createDataFrame([(9, "РОМАШКА"), (5, "ао «ромашка»"), (7, "завод"), (1, ""), (2, None), (3, ". ;")], "org_id long, name string")
    df = journal.with_cards(found, cards)
    joins = [line for line in plan(df).splitlines() if "SortMergeJoin" in line or "Exchange hashpartitioning" in line]
    assert len(joins) > 2 and not any("regexp_replace" in line for line in joins)
    card = {"ООО Ромашка": 5, "ромашка": 5, "Завод": 7}
    want = [(i % 5, names[i % 8], names[i // 8 % 8], card.get(names[i % 8]), card.get(names[i // 8 % 8])) for i in range(64)]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_rows_without_a_name_are_spread(spark, shuffled):
    found = spark.range(0, 4000, 1, 4).selectExpr("id AS doc", "IF(id % 2 = 0, ' ', NULL) AS customer", "'' AS manufacturer")
    cards = spark.createDataFrame([(1, ""), (2, None), (3, "завод")], "org_id long, name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = journal.with_cards(found, cards)
        held = [r["count"] for r in df.withColumn("p", F.spark_partition_id()).groupBy("p", "customer_org_id", "manufacturer_org_id").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(held) == 4 and max(held) < 1400 and df.filter("customer_org_id IS NULL AND manufacturer_org_id IS NULL").count() == 4000


def test_accepted_needs_no_window(spark):
    rows = [(1, 1, "ВВГ 3х2,5", "ТУ", False), (1, 2, "ВВГ 3х2,5", "", True), (1, 3, "x", "ТУ", False), (2, 1, None, None, False), (2, 2, "", "ТУ", True)]
    df = validate.marks(spark.createDataFrame(rows, "doc int, pos int, mark string, document string, ocr boolean"), "doc", "pos", "ocr")
    assert "Window" not in plan(df.filter("accepted").groupBy("doc").count())
    got = df.collect()
    assert len(got) == 5 and all(r.accepted == (r.status != "error") for r in got) and {r.accepted for r in got} == {True, False}
    assert "Window" not in plan(extraction._checked_marks(spark, SF).filter("accepted").select("doc"))


def test_batches_share_one_reading(spark, monkeypatch):
    """What is appended comes from rows that were written, not from requests that are read again for each batch."""
    made = []
    monkeypatch.setattr(journal, "entries", lambda *a, f=journal.entries: made.append(f(*a).withColumn("marks_count", F.col("marks_count") + 0 * F.rand().cast("long"))) or made[-1])
    seen = []
    monkeypatch.setattr(extraction, "save", lambda df, f=extraction.save: seen.append(df) or f(df))
    assert extraction.extraction_journal(spark, SF).count() == made[0].count() and seen == made


def test_names_are_normalised_as_before(spark):
    r = random.Random(5)
    parts = ["ООО ", "ооо", "АО", "ПАО ", "Зао ", "общество с ограниченной ответственностью ", "«", "»", '"', "'", "`", "{", "]", " ", "\t", "\n", " ", ".", ",", ";", "-", "–", "ромашка", "Я", "x", "заказчик", "завод-building", "i.ivanov", "customer"]
    names = {"".join(r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(3000)} | set(parts)
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    old = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce("name", F.lit("")))), r"[«»\"'`{}\[\]]", ""), r"\s+", " "))
    for form in rules.LEGAL_FORMS:
        old = F.regexp_replace(old, f"^{form} ", "")
    old = F.regexp_replace(F.regexp_replace(old, r"^[ .,;-]+", ""), r"[ .,;-]+$", "")
    assert df.select("name", organisation_key(F.col("name")).alias("new"), old.alias("old")).filter("new <> old").collect() == []
    raw = F.trim(F.coalesce("name", F.lit("")))
    word = (raw == "") | old.isin(rules.PLACEHOLDER_NAMES) | raw.rlike(r"^[a-z]\.[a-z]{3,20}$")
    ours = F.contains(F.regexp_replace(old, r"[\s–—-]+", ""), F.lit("заводbuilding"))
    n, own = F.col("name"), ["ООО «Завод – building»", "", "."]
    got = df.select("name", extract.nobody(n, own).alias("a"), (word | ours).alias("b"), extract.placeholder(n).alias("c"), word.alias("d"), extract.own_laboratory(n, own).alias("e"), ours.alias("f"))
    assert got.filter("a <> b OR c <> d OR e <> f OR a IS NULL").collect() == [] and got.filter("c").count() > 10 and got.filter("e").count() > 10
    assert not df.select(extract.own_laboratory(n, []).alias("x")).filter("x").count()

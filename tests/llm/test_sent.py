"""What near dedup sends: each text once where copies are alike, rows picked by bitmaps without a shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ordlake.llm import common, minhash as m


@pytest.fixture
def family(spark, tmp_path):
    """(row, text) of six near copies and ten other texts, as written."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(20, 26)]
    texts += [" ".join(f"x{r.randrange(10**6)}" for _ in range(80)) for _ in range(10)]
    spark.createDataFrame(list(enumerate(texts)), "row long, text string").write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


def test_a_text_of_a_small_family_is_sent_once(family, monkeypatch):
    seen = []
    verified = m._verified

    def counted(pairs, texts):
        cell = [c for c in pairs.columns if c not in ("a", "b")]
        seen.append((pairs.count(), pairs.select(*cell, F.explode(F.array("a", "b")).alias("node")).distinct().count()))
        return verified(pairs, texts)

    monkeypatch.setattr(m, "_verified", counted)
    got = m.near_duplicates(family.withColumnRenamed("row", "doc_id")).collect()
    assert sorted(r.cluster_id for r in got) == [0] * 6 + list(range(6, 16))
    assert seen == [(15, 6)]


def test_many_texts_are_shuffled_with_the_same_result(family, monkeypatch):
    docs = family.withColumnRenamed("row", "doc_id")
    few = sorted(m.near_duplicates(docs).collect())
    monkeypatch.setattr(m, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(m, "PAIRS_CELL", 2)
    assert sorted(m.near_duplicates(docs).collect()) == few


def test_bitmaps_hold_the_numbers_given(spark):
    r = random.Random(5)
    every = [0, 1, 7, 8, 32767, 32768, 32769, 65536, *(p << 33 for p in range(1, 5)), *((p << 33) + r.randrange(90000) for p in range(3) for _ in range(300))]
    every = sorted(set(every))
    own = set(r.sample(every, len(every) // 2)) | {0, 32768}
    bits = common.save(common.bitmaps(spark.createDataFrame([(x,) for x in own for _ in range(2)], "n long")))
    rows = spark.createDataFrame([(x, "a") for x in every], "at long, bits string")
    kept, left = (common.marked(rows, F.col("at"), bits, keep) for keep in (True, False))
    assert kept.columns == left.columns == ["at", "bits"]
    assert sorted(x["at"] for x in kept.collect()) == sorted(own) and sorted(x["at"] for x in left.collect()) == sorted(set(every) - own)
    assert not any("Exchange hashpartitioning" in p._jdf.queryExecution().sparkPlan().toString() for p in (kept, left))

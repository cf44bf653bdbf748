from __future__ import annotations

import hashlib
from collections import defaultdict

from ordlake.llm import bloom, common, exact_dedup as m


def test_equals_brute_force(docs, texts):
    got = m.exact_duplicates(docs).collect()
    assert len(got) == len(texts)
    groups = defaultdict(list)
    for i, t in texts:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    largest = lambda ids: max((i for i in ids if i is not None), default=None)
    for r in got:
        own = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (largest(own), len(own))
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_keeps_columns_and_one_row_each(docs, texts, empty):
    kept = m.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({t or "" for _, t in texts})
    assert m.drop_exact_duplicates(empty).count() == 0 and m.exact_duplicates(empty).count() == 0


def test_filter_finds_every_repeat(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id % 4900) AS h").repartition(5)
    bits = bloom.seen_filter(rows, 5000, 2)
    flagged = rows.withColumn("again", bloom.possibly_in(spark, bits)("h"))
    repeated = rows.groupBy("h").count().filter("count > 1").select("h")
    assert flagged.join(repeated, "h").filter("not again").count() == 0
    assert flagged.filter("again").count() < 400


def test_small_join(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS k", "id * 2 AS v").repartition(4)
    side = spark.range(0, 3000, 50).selectExpr("id AS k")
    for bound in (100, 10):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        assert common.small_join(rows, side, "k", "inner").count() == 60
        assert common.small_join(rows, side, "k", "left_anti").count() == 2940

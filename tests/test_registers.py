"""Merged registers, ledgers over restarts, packs, checked imports and replaced documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ordlake.operators import merge
from ordlake.scratch import save
from ordlake.sources import packs, sinks
from ordlake.streaming import ledger


def groups_of(rows):
    """Root of each id by union of all ids that share a key."""
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in (1, 2):
        seen = {}
        for r in rows:
            if r[k] and r[k].strip():
                a, b = find(r[0]), find(seen.setdefault(r[k].strip(), r[0]))
                root[max(a, b)] = min(a, b)
    return {r[0]: find(r[0]) for r in rows}


def test_linked_chains_and_hot_keys(spark):
    r = random.Random(1)
    rows = [(i, f"t{i // 2}", f"n{(i + 1) // 2}") for i in range(0, 80)]  # one chain of 80 steps
    rows += [(1000 + i, "hot", None) for i in range(60)] + [(2000 + i, r.choice([None, "", " ", f"x{r.randrange(40)}"]), f"y{r.randrange(60)}") for i in range(90)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, tax string, name string").repartition(4)
    assert {x.id: x.root for x in merge.linked(df, "id", ["tax", "name"], save).collect()} == groups_of(rows)


def test_merge_fills_blanks_and_moves(spark):
    rows = [(5, None, "a", None, "p5"), (3, "T", "a", " ", None), (9, "T", "b", "street", "p9"), (4, None, "z", None, None), (None, None, "a", "x", "x")]
    df = spark.createDataFrame(rows, "id long, tax string, name string, street string, phone string")
    merged, moved = merge.merge_linked(df, "id", ["tax", "name"], F.coalesce("tax", F.lit("")) != "", ["street", "phone"], save)
    assert sorted(map(tuple, merged.collect())) == [(3, "T", "a", "street", "p9"), (4, None, "z", None, None)]
    assert sorted(map(tuple, moved.collect())) == [(5, 3), (9, 3)]
    empty = spark.createDataFrame([], df.schema)
    assert merge.merge_linked(empty, "id", ["tax"], F.lit(True), ["street"], save)[0].count() == 0


def test_ledger_after_a_kill(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "k string, at long, v string").schema
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{name}")
    run = lambda: ledger.tail_json(spark, f"{tmp_path}/in/*", schema, ["k"], "at", ["v"], f"{tmp_path}/table", f"{tmp_path}/state")
    now = lambda: sorted((r.k, r.v) for r in ledger.current(spark, f"{tmp_path}/table", ["k"], "at").collect())
    put("a", [("x", 1, "old"), ("y", 1, "one")])
    run()
    put("b", [("x", 2, "new"), ("z", 1, "z")])
    with monkeypatch.context() as m:
        m.setattr(ledger, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            run()  # data is written, the entry is not
    assert now() == [("x", "old"), ("y", "one")]
    run()
    assert now() == [("x", "new"), ("y", "one"), ("z", "z")]
    put("c", [("x", 1, "old"), ("y", 1, "one")])  # the first file again, under another name
    run()
    assert now() == [("x", "new"), ("y", "one"), ("z", "z")]
    entries = ledger.entries(spark, f"{tmp_path}/table").filter("file IS NOT NULL").collect()
    assert len(entries) == 2 and len({r.h for r in entries}) == 2


def test_a_batch_that_has_its_entry_is_skipped(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], "k string, at long, v string").schema
    spark.createDataFrame([("x", 1, "a")], schema).write.json(f"{tmp_path}/in/a")
    run = lambda: ledger.tail_json(spark, f"{tmp_path}/in/*", schema, ["k"], "at", ["v"], f"{tmp_path}/table", f"{tmp_path}/state")
    real = ledger.commit

    def late(*a):
        real(*a)
        raise RuntimeError("killed")  # before Spark notes the batch

    with monkeypatch.context() as m:
        m.setattr(ledger, "commit", late)
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    assert [tuple(r) for r in ledger.current(spark, f"{tmp_path}/table", ["k"], "at").collect()] == [("x", 1, "a")]
    assert ledger.entries(spark, f"{tmp_path}/table").select("batch").distinct().count() == 1


def test_inbox(spark, tmp_path):
    inbox = tmp_path / "inbox" / "deep"
    inbox.mkdir(parents=True)
    (inbox / "a.txt").write_text("one")
    (inbox / "b.json").write_text("{}")
    (inbox / "c.bin").write_bytes(b"\0")
    run = lambda: ledger.ingest(spark, str(tmp_path / "inbox"), f"{tmp_path}/table", f"{tmp_path}/state")
    assert run() == {"registered": 2, "known": 0, "quarantined": 1}
    assert run() == {"registered": 0, "known": 0, "quarantined": 0}
    (inbox / "copy.txt").write_text("one")
    (inbox / "d.txt").write_text("two")
    (inbox / "e.txt").write_text("two")
    assert run() == {"registered": 1, "known": 2, "quarantined": 0}
    rows = ledger.registered(spark, f"{tmp_path}/table").collect()
    assert sorted((r.kind, r.text) for r in rows) == [("json", "{}"), ("text", "one"), ("text", "two")]
    assert ledger.registered(spark, f"{tmp_path}/table", "quarantine").count() == 1


def test_packs(spark, tmp_path):
    rows = spark.range(10).selectExpr("timestamp_seconds(id) AS at", "id AS v", "CASE WHEN id < 8 THEN 'ü' END AS t")
    rows = rows.unionByName(rows.filter("v = 3"))  # a repeated row
    marks = packs.export_pack({"a": rows.filter("v < 5"), "b": rows.limit(0)}, "at", f"{tmp_path}/packs", "p1", None)
    assert list(marks) == ["a"]
    got = lambda name: [tuple(r) for r in packs.import_pack(spark, f"{tmp_path}/packs", name, f"{tmp_path}/store").collect()]
    assert got("p1") == [("a", 5, 1)] and got("p1") == [("a", 0, 6)]
    later = packs.export_pack({"a": rows, "b": rows.filter("v > 100")}, "at", f"{tmp_path}/packs", "p2", marks)
    assert later["a"] > marks["a"] and got("p2") == [("a", 5, 0)]
    stored = spark.read.parquet(f"{tmp_path}/store/a")
    assert stored.count() == 10 and stored.filter("t IS NULL").count() == 2


def test_checked_import(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("", -1), (None, 2), ("b", None)], "code string, cost int")
    rules = {"no code": F.coalesce("code", F.lit("")) == "", "cost": F.col("cost") <= 0}
    want = {"n_rows": 4, "n_rejected": 2, "no code": 2, "cost": 1}
    assert packs.import_checked(df, rules, None) == want == packs.import_checked(df, rules, f"{tmp_path}/x")
    back = spark.read.parquet(f"{tmp_path}/x")
    assert back.filter("accepted = 'true'").count() == 2
    assert sorted(len(r.reasons) for r in back.filter("accepted = 'false'").collect()) == [1, 2]


def test_replaced_documents(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.store_by_bucket(spark.range(40).selectExpr("id", "'old' AS v"), path, "id", 8)
    kept = sinks.replace_documents(spark, path, spark.createDataFrame([(3, "new"), (3, "more"), (99, "added")], "id long, v string"), "id", 8)
    assert kept == 7  # 3 and 99 share a bucket
    rows = sorted((r.id, r.v) for r in spark.read.parquet(path).collect())
    assert rows == sorted([(i, "old") for i in range(40) if i != 3] + [(3, "new"), (3, "more"), (99, "added")])

"""Tables that steps write on the way are gone once their result is there; those that a result still reads stay."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from ordlake.llm import common, minhash

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shared(tmp_path, monkeypatch):
    """A new shared folder; called, it gives the names of the tables in it."""
    made = iter(range(10**6))
    monkeypatch.setattr(common, "folder", lambda spark: f"{tmp_path}/{next(made)}")
    return lambda: sorted(p.parent.name for p in tmp_path.rglob("_SUCCESS"))


def test_settled_keeps_its_result_alone(spark, shared):
    rows = common.save(spark.range(5), "rows")
    out = common.settled(spark, lambda: common.settled(spark, lambda: common.save(rows, "a").join(common.save(rows, "b"), "id"), "inner"), "outer")
    assert shared() == ["outer", "rows"] and out.count() == 5


def test_a_step_that_fails_leaves_nothing(spark, shared):
    def step(df):
        common.save(df, "a")
        raise ValueError

    with pytest.raises(ValueError):
        common.transient(step)(spark.range(5))
    assert shared() == [] and common._open_scopes() == []


def test_stages_leave_only_what_their_results_read(spark, docs, shared):
    left = {"toxicity": [], "exact dedup": [], "near dedup": ["gone", "numbered"], "mixing": ["measured"], "byte-level BPE": ["tokens"]}
    before: list[str] = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert shared() == sorted(before + left[name]), name
        assert out.count() <= docs.count()
        before = shared()


def test_run_leaves_its_result_alone(spark, shared):
    out = corpus_pipeline.run(spark, SF)
    assert shared() == ["byte-level_BPE"] and out.count() > 0


def test_texts_on_the_way_are_packed(spark, docs, shared, tmp_path):
    minhash.drop_near_duplicates(docs)
    numbered = next(p.parent for p in tmp_path.rglob("_SUCCESS") if p.parent.name == "numbered")
    assert all(".zstd." in p.name for p in Path(numbered).glob("*.parquet"))


def test_only_shared_buckets_meet(spark):
    classes = spark.createDataFrame([(1, [7, 8]), (2, [7, 9]), (3, [5, 9]), (4, [7, 6])], "node long, bands array<long>")
    got = {(r.band, r.node, r.k, r.n) for r in minhash._shared_buckets(classes).collect()}
    assert got == {(7, 1, 0, 3), (7, 2, 0, 3), (7, 4, 0, 3), (9, 2, 1, 2), (9, 3, 1, 2)}

"""Rows are dealt into tasks by their number, and are read once."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from ordlake.operators import mining, validate
from ordlake.plans import extraction, pricing, texts
from ordlake.plans.common import spread
from ordlake.scratch import save

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_tasks_grow_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10), 10, "id").rdd.getNumPartitions() == cores
    assert spread(spark.range(10), cores * 1000 + 1, "id", each=500).rdd.getNumPartitions() == cores * 2 + 1


def test_letter_ratio_is_dealt(spark):
    assert "REPARTITION_BY_NUM" in plan(texts.letter_ratio(spark, SF))


def test_requests_are_dealt_and_designations_read_once(spark):
    p = plan(extraction.document_facts(spark, SF))
    assert "REPARTITION_BY_NUM" in p


def test_order_lines_are_dealt(spark):
    assert "REPARTITION_BY_NUM" in plan(pricing.order_cost_totals(spark, SF))
    assert "REPARTITION_BY_NUM" in plan(pricing.proposal_totals(spark, SF))


def test_roles_read_their_rows_once(spark):
    rows = [(1, 1, "Завод А", "unknown", "manufacturer", True), (1, 2, "Б", "unknown", "dealer", True), (2, 1, "В", None, "unknown", False)]
    df = spark.createDataFrame(rows, "doc int, pos int, name string, role string, org_type string, direction boolean")
    out = validate.roles(df, "doc", "pos", "direction")
    assert "Union" not in plan(out)
    got = sorted((r.doc, r.pos, r.role or "-") for r in out.collect())
    assert got == [(1, 1, "customer"), (1, 1, "unknown"), (1, 2, "unknown"), (2, 1, "-")]


def test_rows_of_one_key_are_one_document(spark):
    df = spark.createDataFrame([("a", "x y z"), ("a", "x y"), ("b", "x y x y"), (None, "x y"), (None, "y z"), (None, "x y")], "doc string, text string")
    got = {(r.phrase, r.n_words, r.support) for r in mining.frequent_phrases(df, "doc", F.split("text", " "), 2, 3, save, shortest=2).collect()}
    assert got == {("x y", 2, 3), ("y z", 2, 2)}

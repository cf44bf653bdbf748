"""Every registered query equals its SQL on DuckDB."""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from ordlake.operators import match
from ordlake.plans import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else repr(x)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, str(SF))
    got = oracle.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(got.fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_fuzzy_names_equal_all_pairs(spark):
    def compact(x):
        return "".join(x.upper().split()).replace("×", "Х").replace("X", "Х")

    def token(x):
        start = re.match("[А-ЯЁA-Z]{2,10}", compact(x))
        return re.split("НГ|NG|LS|HF|FR", start.group())[0][:6] if start else ""

    def alike(x):
        return "".join(x.lower().split()).replace("×", "х").replace("x", "х").replace("ё", "е")

    def compatible(a, b):
        n = min(len(a), len(b), 4)
        return not a or not b or a == b or (n >= 3 and a[:n] == b[:n])

    names = ["КСБнг(А)-LS 3x2", "КСБГнг(А)-LS 3х2,5", "КСБГ 3х2", "ПВСнг 3х2", "ПВС 3 х 2", "A", "ВВГнг 3х1", "ВВГЭнг 3х1", "VVGng 1x1", "VVGn 1X1", "А3х2,5", "АВ3х2,5", "3х2,5", "Ёж 3х2", "еж 3x2"]
    names += sorted({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()})[:60]
    df = spark.createDataFrame([(n,) for n in names], "left_name string")
    got = match.fuzzy_names(df, "left_name", df.withColumnRenamed("left_name", "right_name"), "right_name", 0.72, 0.86, 5).collect()
    want = []
    for a in names:
        scored = sorted((-round(SequenceMatcher(None, alike(a), alike(b)).ratio(), 6), len(b), b) for b in set(names) if compatible(token(a), token(b)))
        best = [(a, b, -s) for s, _, b in scored if -s >= 0.72][:5]
        want += [(*x, k == 0 and x[2] >= 0.86) for k, x in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(set(want)) and len(got) > len(names)

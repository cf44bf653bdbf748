from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ordlake import rules
from ordlake.functions import marks, money, text
from ordlake.operators import cost, match, merge, quality, ranking, relational
from ordlake.sources import files, sinks


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_money(spark):
    assert str(one(spark, money.money(F.col("x")), x=1.005)) == "1.01"
    assert one(spark, money.format_money(F.col("x")), x=1234567.891) == "1 234 567,89"


def test_line_costs(spark):
    def price(rule, base, q=1, cores=1, groups=1, hours=None, per=0.0, default=None, factor=1.0):
        row = spark.range(1).select(cost.line_cost(F.lit(rule), F.lit(base), F.lit(q), F.lit(cores), F.lit(groups), F.lit(hours).cast("double"), F.lit(per), F.lit(default).cast("double"), F.lit(factor))).first()
        return float(row[0])

    assert price("fixed", 400.0, 3) == 1200
    assert price("per_core", 10.555, 2, cores=3) == 63.34  # 31.665 is rounded before the quantity
    assert price("per_group", 7.0, 1, groups=4) == 28
    assert price("time_based", 100.0, 2, hours=0.0, per=2.0, default=24.0) == 296  # 0 hours count as not given
    assert price("time_based", 100.0, 1, hours=10.0, per=2.0, default=24.0) == 120
    assert price("prepared", 300.0, factor=1.5) == 450


def test_order_totals(spark):
    lines = spark.createDataFrame([(1, 400.0), (2, 20000.0)], "o int, c double")
    got = {r.o: r for r in cost.order_totals(lines, "o", "c", 15000, markup=10, discount=10).collect()}
    assert float(got[1].top_up) == 14600 and float(got[1].total_net) == 14850 and float(got[2].top_up) == 0
    assert float(got[2].total_gross) == round(19800 * 1.22, 2)


def test_quantities(spark):
    tests = spark.createDataFrame([("o", "a"), ("o", "a"), ("o", "b"), ("o", " ")], "o string, code string")
    explicit = spark.createDataFrame([("o", "b", 3), ("o", "a", 1), ("o", "c", 0)], "o string, code string, quantity long")
    assert {(r.code, r.quantity) for r in cost.quantities(tests, explicit, ["o", "code"]).collect()} == {("a", 2), ("b", 3)}


def test_category_position(spark):
    assert one(spark, cost.category_position(F.col("c")), c=rules.CATEGORY_ORDER[2]) == 2
    assert one(spark, cost.category_position(F.col("c")), c="else") == len(rules.CATEGORY_ORDER)


@pytest.mark.parametrize(("raw", "expected"), [("2.3.1 - 2.3.6", [f"2.3.{i}" for i in range(1, 7)]), ("1.2; 1.4, 1.2", ["1.2", "1.4"]), ("1.1-1.99", ["1.1-1.99"]), ("", [])])
def test_clauses(spark, raw, expected):
    assert one(spark, text.clauses(F.col("x")), x=raw) == expected


def test_text(spark):
    x = F.col("x")
    assert one(spark, text.phrase(x), x="Ёлка,  (A-1)") == "елка a 1"
    assert one(spark, text.word_set(x), x="Измерение сопротивления жил") == ["жил", "сопротивления"]
    assert one(spark, text.organisation_key(x), x="ООО «Ромашка»") == "ромашка"
    assert one(spark, text.needs_ocr(x, F.lit(True)), x="latin only") and not one(spark, text.needs_ocr(x, F.lit(True)), x="русский текст")
    assert one(spark, text.character_error_rate(F.lit("abd"), x), x="abc") == pytest.approx(1 / 3)
    assert one(spark, text.character_error_rate(F.lit("a"), x), x="") is None
    assert one(spark, text.drop_repeated_neighbours(F.split(x, ",")), x="a,a,b,a,a") == ["a", "b", "a"]
    assert one(spark, text.table_text(F.array(F.array(F.split(x, ",")))), x="a,b") == "a b"


def test_marks(spark):
    m = one(spark, marks.parse_mark(F.col("x")), x="КСБнг(A)-FRLS 2х2х0,98")
    assert (m.brand, m.cores, m.groups, m.size, m.is_lan) == ("КСБнг(A)-FRLS", 4, 2, 0.98, True)
    m = one(spark, marks.parse_mark(F.col("x")), x="кабель")
    assert (m.cores, m.groups, m.size) == (1, 1, 1.0)
    assert one(spark, marks.after_ocr(F.col("x")), x="BBГнг ( A ) -LS  3 x 2,5") == "ВВГнг(\u0410)-LS 3х2,5"


def test_aliases(spark):
    a = spark.createDataFrame([(1, "gear", "G"), (2, "old gear", "O"), (3, "rod", "R")], "alias_id int, alias string, code string")
    p = spark.createDataFrame([(1, "old gear"), (2, "very old gear box"), (3, "rods"), (4, "rod")], "id int, t string")
    assert {(r.id, r.code, r.exact) for r in match.resolve_alias(p, "id", "t", a).collect()} == {(1, "O", True), (2, "G", False), (4, "R", True)}


def test_rule_tables_are_bounded(spark):
    with pytest.raises(ValueError):
        match.small(spark.range(20), 10)


def test_ratio(spark):
    got = one(spark, match.ratio(F.col("a"), F.col("b")), a="abcng", b="abcngl")
    assert got == pytest.approx(SequenceMatcher(None, "abcng", "abcngl").ratio())


def test_contained_phrases(spark):
    p = spark.createDataFrame([("red bolt", "A", 0.8), ("bolt", "A", 0.9), ("gear", "B", 0.5)], "pattern string, code string, confidence double")
    d = spark.createDataFrame([(1, "a Red  bolt"), (2, "bolts"), (3, None), (4, "gear. gear")], "id int, t string")
    assert {(r.id, r.code, r.confidence, r.pattern) for r in match.contained_phrases(d, "id", "t", p).collect()} == {(1, "A", 0.9, "bolt"), (2, "A", 0.9, "bolt"), (4, "B", 0.5, "gear")}


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", None, 5), (2, "b", "x", 1)], "k int, a string, b string, n int")
    new = spark.createDataFrame([(1, None, "y", 3), (3, "c", None, 9)], "k int, a string, b string, n int")
    got = {r.k: tuple(r)[1:] for r in merge.upsert(old, new, "k", {"a": merge.OVERWRITE, "b": merge.FILL_NEW, "n": merge.GREATEST}).collect()}
    assert got == {1: (None, "y", 5), 2: ("b", "x", 1), 3: ("c", None, 9)}
    assert merge.upsert(merge.upsert(old, new, "k", {"a": "keep_old", "b": "fill_new", "n": "greatest"}), new, "k", {"a": "keep_old", "b": "fill_new", "n": "greatest"}).count() == 3


def test_survivors(spark):
    df = spark.createDataFrame([(1, "k", False), (2, "k", True), (3, "k", True), (4, "z", False)], "id int, key string, inn boolean")
    assert {tuple(r) for r in merge.survivors(df, "key", "id", F.col("inn")).collect()} == {(1, 2), (3, 2)}


def test_quality(spark):
    e = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "b"), ("x", "q")], "doc string, m string")
    p = spark.createDataFrame([("d", "b"), ("d", "c")], "doc string, m string")
    got = {r.doc: r for r in quality.precision_recall(e, p, "doc", "m").collect()}
    assert (got["d"].recall, got["d"].precision, got["d"].n_raw) == (0.5, 0.5, 3) and got["x"].precision is None
    c = {r.doc: r for r in quality.compare(e, p, "doc", "m").collect()}
    assert (c["d"].n_both, c["d"].only_a, c["d"].only_b, c["d"].jaccard) == (1, 1, 1, 0.3333)


def test_ranking(spark):
    df = spark.createDataFrame([("g", "ab"), ("g", "abc"), ("g", "b"), ("g", "abd"), ("h", "ab")], "g string, n string")
    assert {tuple(r) for r in ranking.drop_prefixes(df, "g", "n").collect()} == {("g", "abc"), ("g", "abd"), ("g", "b"), ("h", "ab")}
    lines = spark.createDataFrame([(1, "a\nb\na\nccc")], "k int, t string")
    assert ranking.unique_lines(lines, "k", "t", 4).first().compact == "a\nb"


def test_in_use(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    facts = spark.createDataFrame([(1,), (1,)], "fk int")
    assert {tuple(r) for r in relational.in_use(keys, "k", {"n": (facts, "fk")}).collect()} == {(1, 2, False), (2, 0, True)}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc": "d", "field": "f"}\nnot json\n{"doc": "d", "field": "f"}\n')
    good, bad = files.corrections(spark, str(tmp_path / "a.jsonl"))
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "p.json").write_text('[{"code": "c", "name": "n", "base_cost": 2.5, "rule_params": {"k": "v"}}, {"name": "no code"}]')
    assert [r.code for r in files.price_list(spark, str(tmp_path / "x")).collect()] == ["c"]
    known, unknown = files.documents(spark, str(tmp_path))
    assert known.count() == 2 and unknown.count() == 0
    assert files.text_lines(spark, str(tmp_path / "a.jsonl")).count() == 4
    assert files.with_fallback(spark, [spark.range(3), spark.range(30), spark.range(1)], 20).count() == 30


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, p string")
    sinks.append(df, str(tmp_path / "t"), ["p"])
    sinks.replace_partitions(df.filter("p = 'a'").withColumn("n", F.lit(9)), str(tmp_path / "t"), ["p"])
    assert {(r.n, r.p) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(9, "a"), (2, "b")}
    t = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-02-01 00:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("at"))
    assert sinks.export_delta({"x": t}, "at", "2024-01-15 00:00:00", str(tmp_path / "d")).first().n_rows == 1

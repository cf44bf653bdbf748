"""Rule tables and mining against plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from ordlake.operators import mining, rulebook
from ordlake.scratch import save


def test_family_rules(spark):
    families = [("a", 2, 0.5, True), ("b", 1, 0.9, True), ("c", 3, 0.0, False), ("d", 4, 0.2, True)]
    parts = [("a", "marker", "x+y"), ("a", "marker", "zz"), ("a", "hint", "tab"), ("a", "brand", "КСБ"), ("b", "sender", "^от"), ("b", "hint", "h1"), ("b", "hint", "h2"), ("c", "marker", "."), ("d", "brand", "solo")]
    texts = [None, "", "xxy and tab", "ZZ ксб", "От h1", "от h1 H2", "solo", "nothing", "w " * 3000 + "zz tab"]

    def best(text):
        head, found = (text or "")[:4000], []
        for name, priority, threshold, enabled in families:
            if not enabled or not head:
                continue
            of = lambda p, name=name: [x for f, q, x in parts if f == name and q == p]
            hits = {p: sum(bool(re.search(x, head, re.I)) for x in of(p)) for p in ("marker", "hint", "sender")}
            total = sum(len(of(p)) for p in hits)
            score = sum(hits.values()) / total if total else 0.0
            if hits["hint"]:
                score = max(score, 0.25 + hits["hint"] / len(of("hint")) * 0.65)
            if any(b.lower() in head.lower() for b in of("brand")):
                score = min(1.0, score + 0.2)
            found.append((-round(score, 2), priority, name, threshold))
        s, _, name, threshold = min(found, default=(0, 0, None, 1))
        return (name if s < 0 and -s >= threshold else None, abs(s))

    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = rulebook.detect_family(df, "id", "text", spark.createDataFrame(families, "family string, priority int, threshold double, enabled boolean"), spark.createDataFrame(parts, "family string, part string, pattern string"))
    assert [(r.family, r.score) for r in got.orderBy("id").collect()] == [best(t) for t in texts]


def test_rules_in_order_and_first_rule(spark):
    df = spark.createDataFrame([("aXb",), ("",), (None,), ("цЦ",)], "t string")
    rules = spark.createDataFrame([(2, "y", "z"), (1, "x", "yy"), (3, "ц", "c")], "position int, pattern string, replacement string")
    assert [r.out for r in rulebook.replace_in_order(df, "t", rules, "out").collect()] == ["azzb", "", "", "cc"]
    phrase = spark.createDataFrame([(1, "x", "lost"), (2, "b", "B"), (3, "ц", "C")], "position int, pattern string, code string")
    known = spark.createDataFrame([("B",), ("C",)], "code string")
    codes = lambda d: [r.rule.code if r.rule else None for r in d.collect()]
    assert codes(rulebook.first_rule(df, "t", phrase)) == ["lost", None, None, "C"]
    assert codes(rulebook.first_rule(df, "t", phrase, known)) == [None, None, None, "C"]
    too_many = spark.range(10_001).selectExpr("CAST(id AS INT) AS position", "'x' AS pattern", "'c' AS code")
    with pytest.raises(ValueError, match="at most"):
        rulebook.first_rule(df, "t", too_many)


def test_examples_and_candidates(spark):
    docs = [(i, t) for i, t in enumerate(["AB-12 and AB-12, CD-9", "ab-12", "AB-12", "test AB-12 XY-77", None, "AB-12"])]
    df = spark.createDataFrame(docs, "doc long, text string").repartition(3)
    got = {(r.kind, r.candidate): (r.n_docs, r.n_places, r.examples) for r in mining.candidates(df, "doc", "text", {"mark": "[A-Z]{2}-[0-9]+", "word": "[a-z]{3,}"}, 4, "^test", 2).collect()}
    least = lambda c, ids: sorted(ids, key=lambda i: md5(f"mark|{c}|{i}".encode()).hexdigest())[:2]
    assert got == {("mark", "ab-12"): (4, 5, least("ab-12", [0, 2, 3, 5])), ("mark", "cd-9"): (1, 1, [0]), ("mark", "xy-77"): (1, 1, [3])}


@pytest.mark.parametrize("support", [2, 3])
def test_frequent_phrases(spark, support):
    r = random.Random(support)
    docs = [(i % 50, " ".join(r.choice("abcd") * r.randint(1, 2) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(None, "a b c"), (7, None)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc long, text string").repartition(3)
    counts = defaultdict(set)
    for i, (_, t) in enumerate(docs):
        w = (t or "").split()
        for n in range(1, 5):
            for k in range(len(w) - n + 1):
                counts[" ".join(w[k : k + n])].add(i)
    want = {(p, p.count(" ") + 1, len(d)) for p, d in counts.items() if len(d) >= support}
    got = mining.frequent_phrases(df, "doc", F.split(F.coalesce("text", F.lit("")), " "), support, 4, save)
    assert {tuple(x) for x in got.collect()} == want and len(want) > 30
    assert mining.frequent_phrases(df.limit(0), "doc", F.split("text", " "), support, 4, save).count() == 0

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordlake.llm import mixing as m

SF = "/root/testdata/sf0.001"


def plain_rake(cells, targets, share):
    """Iterative proportional fitting with whole cells taken out, in plain Python."""
    budget = share * sum(cells.values())
    p = {k: share for k, v in cells.items() if v > 0}
    whole: set = set()
    goal = []
    for d, t in enumerate(targets):
        own = {c: s for c, s in t.items() if any(k[d] == c for k in p) and s > 0}
        goal.append({c: budget * s / sum(own.values()) for c, s in own.items()})
    while True:
        rest = budget - sum(cells[k] for k in whole)
        left = []
        for d, g in enumerate(goal):
            now = {c: max(0.0, x - sum(cells[k] for k in whole if k[d] == c)) for c, x in g.items() if any(k[d] == c and k not in whole for k in p)}
            left.append({c: x / sum(now.values()) * rest for c, x in now.items()})
        for k in p:
            p[k] = 1.0 if k in whole else share
        for _ in range(3000):
            for d, g in enumerate(left):
                now = defaultdict(float)
                for k in p:
                    if k not in whole:
                        now[k[d]] += p[k] * cells[k]
                for k in p:
                    if k not in whole and now[k[d]] > 0:
                        p[k] *= g[k[d]] / now[k[d]]
        more = {k for k in p if k not in whole and p[k] > 1}
        if not more:
            return p
        whole |= more


@pytest.mark.parametrize("share", [0.2, 0.6])
def test_equals_plain_raking(share):
    r = np.random.default_rng(1)
    cells = {(a, b, c): float(r.integers(100, 1000)) for a in "xyz" for b in "pq" for c in "mn"}
    targets = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.6, "q": 0.4}, {"m": 0.5, "n": 0.5}]
    got, want = m.allot(cells, targets, share), plain_rake(cells, targets, share)
    assert max(abs(got.probability[k] - want[k]) for k in cells) < 1e-4
    assert max(got.probability.values()) <= 1


def test_marginals_are_met_although_cells_are_taken_whole():
    cells = {("x", "p"): 20.0, ("x", "q"): 400.0, ("y", "p"): 300.0, ("y", "q"): 280.0}
    got = m.allot(cells, [{"x": 0.5, "y": 0.5}, {"p": 0.35, "q": 0.65}], 0.4)
    assert got.gap < 1e-6 and got.probability["x", "p"] <= 1
    assert all(abs(a - b) < 1e-6 for _, _, a, b in got.marginals)
    short = m.allot(cells, [{"x": 0.9, "y": 0.1}, {"p": 0.5, "q": 0.5}], 0.9)
    assert short.gap > 0.1 and max(short.probability.values()) <= 1


def test_tokens_equal_native_ones(docs):
    text = F.coalesce("text", F.lit(""))
    got = m.measure(docs, m.fit_topics(docs), out_col="__m").select("__m.*", F.regexp_count(text, F.lit(r"\S+")).alias("a")).collect()
    assert got and all(r.tokens == r.a and 0 <= r.topic < m.TOPICS for r in got)
    assert m._tokens(pa.array([], pa.string())).tolist() == []


def test_topics_gather_texts_of_a_subject(spark):
    r = np.random.default_rng(3)
    subjects = [[f"w{k}x{j}" for j in range(30)] for k in range(4)]
    common = [f"c{j}" for j in range(30)]
    rows = [(i, "en", " ".join(r.choice(subjects[i % 4] + common, 80))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = defaultdict(lambda: defaultdict(int))
    for x in m.measure(df, m.fit_topics(df)).collect():
        found[x.measure.topic][x.doc_id % 4] += 1
    assert sum(max(v.values()) for v in found.values()) >= 190


def test_operator_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = m.mix_documents(docs).select("doc_id", "source", "lang", "text", "mix.*").collect()
    tokens = [len((r.text or "").encode().split()) for r in got]
    assert [r.tokens for r in got] == tokens
    cells, sums = defaultdict(float), [defaultdict(float) for _ in range(3)]
    for r, n in zip(got, tokens, strict=True):
        cells[tuple(r.cell)] += n
        assert r.cell[:2] == [r.source, r.lang]
        for d in range(3):
            sums[d][r.cell[d]] += n
    want = plain_rake(cells, [{c: n**m.POWER for c, n in s.items()} for s in sums], m.SHARE)
    assert all(abs(r.probability - want.get(tuple(r.cell), m.SHARE)) < 0.01 for r in got)
    chosen = sum(r.tokens for r in got if r.selected)
    assert 0.3 < chosen / sum(tokens) < 0.7
    assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in m.mix_documents(docs.repartition(5)).filter("mix.selected").collect()}


def test_edges(docs, texts, empty):
    out = m.mix_documents(docs)
    assert out.columns == [*docs.columns, "mix_"]  # the fixture has a column mix, which stays
    got = out.select("text", "mix", "mix_.*").collect()
    assert len(got) == len(texts) and all(0 <= r.probability <= 1 and r["mix"] == "m" for r in got)
    assert m.mix_documents(empty).count() == 0


def test_sample_follows_probabilities(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 10 < 9, "src0").otherwise("src1").alias("source"))
    out = m.mix(df, {"source": F.col("source")}, {"source": {"src0": 0.5, "src1": 0.5}}, F.lit(3), 0.1)
    n = {r["source"]: r["count"] for r in out.filter("mix.selected").groupBy("source").count().collect()}
    assert abs(n["src0"] - 1000) < 120 and abs(n["src1"] - 1000) < 120


def test_other_categories(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "new"), (3, "c", "x")], "doc_id long, text string, source string")
    out = m.mix(df, {"source": F.col("source")}, {"source": {"x": 1.0, m.OTHER: 1.0}}, F.lit(1), 0.9)
    assert [r.mix.cell for r in sorted(out.collect())] == [[m.OTHER], [m.OTHER], ["x"]]


def test_documents_without_tokens_are_drawn_at_the_share(spark):
    df = spark.createDataFrame([(i, "e" if i % 2 else "f") for i in range(400)], "doc_id long, source string")
    out = m.mix(df, {"source": F.col("source")}, {"source": {"e": 1.0, "f": 1.0}}, F.when(F.col("source") == "e", 5).otherwise(0), 0.5)
    assert out.filter("source = 'f' and mix.probability = 0.5").count() == 200


def test_topics_are_those_of_all_documents(spark):
    """Weights and means are of every document, over 2,000 of them; how rows are dealt out changes nothing."""
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(i * 7 + j) % 40}" for j in range(12)), ["en", "de", None][i % 3]) for i in range(2600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, again = m.fit_topics(df.repartition(3)), m.fit_topics(df.repartition(7))
    x = m.word_vectors([t.encode() for _, t, _ in rows])
    assert np.allclose(got.idf, np.log(2601 / ((x > 0).sum(axis=0) + 1)) + 1, atol=1e-5)
    unit = m._unit(x * got.idf)
    for lang, of in (("en", 0), ("de", 1)):
        assert np.allclose(got.means[lang], unit[of::3].mean(axis=0), atol=1e-5)
    assert (got.centres == again.centres).all() and (got.idf == again.idf).all()


def test_texts_are_measured_once(spark):
    """One pass over the texts; topics are fitted and given by what it has stored, and equal those of the texts."""
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once = docs.withColumn("text", F.udf(counted, "string")("text"))
    kept = []

    def stored(df):
        kept.append(m.save(df))
        return kept[0].drop("text")

    got = {r.doc_id: r.mix for r in m.mix_documents(once, stored=stored).collect()}
    assert seen.value == docs.count() == len(got)
    topics = {r.doc_id: r.measure for r in m.measure(docs, m.fit_topics(docs)).collect()}
    assert all(x.cell[2] == str(topics[i].topic) and x.tokens == topics[i].tokens for i, x in got.items())


def test_sums_of_a_task_are_one_row_for_a_group(spark):
    """A task sends one row for each group and language, not one for each place; counts and sums are exact."""
    rows = [(i, i % 2, m.word_roots([b"a b b c"] if i % 3 else [b""])[0].as_py()) for i in range(3000)]
    df = spark.createDataFrame(rows, "by long, lang int, v binary").repartition(4)
    sent = spark.sparkContext.accumulator(0)

    def weigh(own, place, weight, lang):
        sent.add(len(lang))
        return lang * 0 + 1, np.rint(weight**2)

    got = m._sums(df, m.ROOTS, ["", "en"], weigh, 2)
    assert set(got) == {(1, ""), (1, "en")} and sent.value == 3000
    one = np.rint(m.word_vectors([b"a b b c"])[0] ** 2).astype(np.int64)
    for lang, of in (("", 0), ("en", 1)):
        total, n = got[1, lang]
        assert n == 1500 and (total == one * sum(1 for i in range(3000) if i % 2 == of and i % 3)).all()

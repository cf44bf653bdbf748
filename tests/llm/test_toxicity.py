from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ordlake.llm import toxicity as m

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    rows, labels, places = [], [], {}
    for i in range(900):
        text, bad = prose(r, r.randint(20, 120)), i % 6 == 0
        sentences = text.split(". ")
        if bad:
            k = r.randrange(len(sentences))
            sentences[k] = f"{r.choice(['Grumble', 'Snark', 'Blarg', 'Snarkish'])} you {sentences[k]}"
            places[i] = k
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), places


def test_held_out_accuracy_and_location(labelled):
    docs, labels, places = labelled
    model = m.train(docs, labels)
    held = m.score(docs, model).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    right = sum((r.toxicity.score >= m.THRESHOLD) == bool(r.toxic) for r in held)
    assert right / len(held) > 0.97
    bad = [r for r in held if r.toxic]
    assert sum(r.toxicity.worst == places[r.doc_id] for r in bad) / len(bad) > 0.9
    assert sum(places[r.doc_id] in r.toxicity.offending for r in bad) / len(bad) > 0.9


def test_edge_cases(labelled, docs, texts, empty, spark):
    train_docs, labels, _ = labelled
    model = m.train(train_docs, labels)
    got = m.score(docs, model).select("text", "toxicity").collect()
    assert len(got) == len(texts)
    seen = {}
    for r in got:
        assert 0 <= r.toxicity.score <= 1 and seen.setdefault(r.text, r.toxicity.score) == r.toxicity.score
        if not (r.text or "").strip(" \n.!?"):
            assert r.toxicity.sentences == 0 and r.toxicity.worst is None and r.toxicity.score < 0.01
    assert m.score(empty, model).count() == 0
    none = m.train(train_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert m.score(train_docs, none).filter("toxicity.score > 0.01").count() == 0


def test_only_allowed_rows_train(labelled):
    docs, labels, _ = labelled
    used = m.training_rows(docs, labels, "doc_id", "text", "toxic")
    assert used.filter(F.crc32(F.col("__id").cast("string")) % 3 == 1).count() == 0


def test_training_is_a_bounded_sample(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"))
    docs, labels = ids.withColumn("text", F.lit("a b")), ids.withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    n = m.training_rows(docs, labels, "doc_id", "text", "toxic").count()
    assert abs(n - m.MAX_TRAINING) < 400
    again = labels.unionByName(labels.filter("doc_id < 1000"))
    assert m.training_rows(docs, again, "doc_id", "text", "toxic").count() == n
    assert m.HASHES * m.MAX_TRAINING // 10**13 > 0  # also ten trillion labels leave a sample


@pytest.mark.parametrize("share", [0.01, 0.03])
def test_words_below_one_in_a_hundred_documents_tell(spark, share):
    r = random.Random(8)
    words = ["Grumble", "Snark", "Blarg", "Zounds"]
    n, every = 4500, round(1 / share)
    texts = [prose(r, r.randint(20, 60)) for _ in range(n)]
    for k, i in enumerate(range(0, n, every)):
        texts[i] = f"{words[k % 4]} you. {texts[i]}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % every == 0).cast("int").alias("toxic"))
    got = m.score(docs, m.train(docs, labels)).select("doc_id", (F.col("toxicity.score") >= m.THRESHOLD).alias("p")).collect()
    assert sum(x.p for x in got if x.doc_id % every == 0) >= 0.95 * len(range(0, n, every))
    assert sum(x.p for x in got if x.doc_id % every) <= 0.005 * n


def test_long_documents_train(spark):
    r = random.Random(9)
    rows = [(i, prose(r, 1700) + (" Grumble you." if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = m.train(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    got = m.score(docs, model).select("doc_id", "toxicity.score").collect()
    assert all((x.score >= m.THRESHOLD) == (x.doc_id % 3 == 0) for x in got)


def test_score_is_a_plain_noisy_or(labelled):
    docs, labels, _ = labelled
    model = m.train(docs, labels)
    softplus = lambda x: math.log1p(math.exp(x))
    for r in m.score(docs, model).filter("doc_id < 60").collect():
        clean, n = 1.0, 0
        for sentence in re.split(r"[.!?\n]", r.text):
            words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", sentence)
            if words:
                n += 1
                weights = [float(model.weights[f]) for _, features, _, _ in m.sentences([sentence.encode()]) for f in features]
                clean *= math.exp(-max(0.0, softplus(sum(weights) + model.bias) - softplus(model.bias)))
        odds = math.log(max(1 - clean, 1e-12)) - math.log(clean)
        assert n == r.toxicity.sentences
        assert abs(r.toxicity.score - 1 / (1 + math.exp(-(odds - model.cut + math.log(0.7 / 0.3))))) < 1e-4


def test_a_column_of_the_result_s_name_stays(spark, labelled):
    model = m.train(*labelled[:2])
    df = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, toxicity string")
    r = m.score(df, model).first()
    assert r.toxicity == "mine" and r.toxicity_.sentences == 1


def test_without_telling_words_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(i, f"word{i} other{i}. more{i}") for i in range(80)], "doc_id long, text string")
    model = m.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert m.score(docs, model).filter("toxicity.score > 0.01").count() == 0

from __future__ import annotations

import hashlib
import itertools
import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

import __spark_entry__
import corpus_pipeline
from ordlake.llm import mixing, toxicity

from .test_byte_bpe import library
from .test_mixing import plain_rake

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op") and n[2].isdigit()} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows_of(df) -> dict:
    return {r.doc_id: r for r in df.collect()}


def words(text: str) -> list[str]:
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]


def shingles(text: str) -> Counter:
    own = words(text)
    return Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4)) if own)


def likeness(x: Counter, y: Counter) -> float:
    """Probability Jaccard, by its definition."""
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def test_toxicity_rejects_by_plain_noisy_or(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = rows_of(stages[0])
    softplus = lambda x: math.log1p(math.exp(x))
    for i, r in rows_of(docs).items():
        clean = 0.0
        for sentence in re.split(r"[.!?\n]", r.text or ""):
            weights = [float(model.weights[f]) for _, own, _, _ in toxicity.sentences([sentence.encode()]) for f in own]
            clean += max(0.0, softplus(sum(weights) + model.bias) - softplus(model.bias))
        odds = math.log(math.expm1(max(clean, 1e-12))) if clean < 30 else clean
        if abs(odds - model.cut) > 1e-3:
            assert (i in kept) == (odds < model.cut)
    assert all(s.columns == docs.columns for s in stages[:-1])


def test_copies_and_near_copies_by_brute_force(stages):
    before, exact, near = (rows_of(s) for s in stages[:3])
    best: dict[str, int] = {}
    for i, r in before.items():
        best[r.text or ""] = max(best.get(r.text or "", -1), i)
    assert set(exact) == set(best.values())
    sets = {i: shingles(r.text or "") for i, r in exact.items()}
    by_shingle = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].add(i)
    parent = {i: i for i in exact}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in {p for own in by_shingle.values() for p in itertools.combinations(sorted(own), 2)}:
        if likeness(sets[i], sets[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert set(near) == {root(i) for i in exact}


def test_the_sample_follows_plain_raking_and_the_fixed_draw(stages):
    near, mixed = stages[2], set(rows_of(stages[3]))
    own = {r.doc_id: r.mix for r in mixing.mix_documents(near).collect()}
    cells, sums = defaultdict(float), [defaultdict(float) for _ in range(3)]
    for r in own.values():
        cells[tuple(r.cell)] += r.tokens
        for d in range(3):
            sums[d][r.cell[d]] += r.tokens
    want = plain_rake(cells, [{c: n**mixing.POWER for c, n in s.items()} for s in sums], mixing.SHARE)
    sure = 0
    for i, r in own.items():
        h = xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
        draw, p = (h >> 11) * 2.0**-53, want.get(tuple(r.cell), mixing.SHARE)
        if abs(draw - p) > 0.01:
            sure += 1
            assert (i in mixed) == (draw < p)
    assert sure > 0.9 * len(own)


def test_tokens_equal_the_library(stages):
    enc, texts, coded = library(), rows_of(stages[3]), rows_of(stages[4])
    assert set(texts) == set(coded) and stages[4].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for i, r in texts.items():
        ids = enc.encode_ordinary(r.text or "")
        assert coded[i].n_tokens == len(ids) and coded[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_run(spark, stages):
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {tuple(r) for r in stages[-1].collect()}


def test_stages_take_any_table(spark, docs, empty):
    """Nulls, empty and long texts, repeated rows and columns with the operators' own names; and no rows at all."""
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, empty, SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).count() == docs.count() and last(spark, empty, SF).count() == 0

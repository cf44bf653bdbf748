from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import functions as F

from ordlake.llm import byte_bpe as m
from ordlake.llm import common

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(spark, docs, texts):
    r = random.Random(2)
    own = [t for _, t in texts] + ["".join(r.choice(" \n\t'stréÜ09日本🙂!?aab  ́") for _ in range(r.randint(0, 200))) for _ in range(300)] + ["a" * 3000, "aaaa aaa aa", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(own)), "n long, text string")
    coded = m.decode(m.encode(df, PATH, public_tokenizers.PATTERN), PATH).withColumn("d", m.digests(F.col("token_ids"), PATH))
    enc = library()
    for x in coded.collect():
        ids = enc.encode_ordinary(x.text or "")
        assert x.token_ids == ids, repr(x.text)
        assert bytes(x.decoded) == (x.text or "").encode()
        assert x.d.n_tokens == len(ids) and x.d.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.d.decoded_sha256 == hashlib.sha256((x.text or "").encode()).hexdigest()


def test_edges(empty, spark):
    assert m.decode(m.encode(empty, PATH, public_tokenizers.PATTERN), PATH).count() == 0
    got = m.decode(spark.createDataFrame([(None,), ([],)], "token_ids array<int>"), PATH).collect()
    assert [bytes(r.decoded) for r in got] == [b"", b""]
    mine = m.encode(spark.createDataFrame([("a", 5)], "text string, token_ids int"), PATH, public_tokenizers.PATTERN).first()
    assert mine.token_ids == 5 and len(mine.token_ids_) == 1


def test_small_parts_change_nothing(texts, monkeypatch):
    pattern, v = regex.compile(public_tokenizers.PATTERN), m.Vocabulary.at(PATH)
    own = pa.array([t for _, t in texts])
    whole = m.encode_texts(own, v, pattern)
    spelled = [bytes(x) for x in m._spelled(whole, v.tokens)]
    for name, value in (("PART", 200), ("WORD_CHARS", 300), ("PIECE", 70)):
        monkeypatch.setattr(m, name, value)
    assert m.encode_texts(own, v, pattern).equals(whole)
    assert [bytes(x) for x in m._spelled(whole, v.tokens)] == spelled == [(t or "").encode() for _, t in texts]


def test_words_are_replayed_once_for_many_batches(monkeypatch):
    pattern, v, seen = regex.compile(public_tokenizers.PATTERN), m.Vocabulary(PATH), []
    replay = m.replay
    monkeypatch.setattr(m, "replay", lambda data, ends, v: seen.append(len(data)) or replay(data, ends, v))
    own = [pa.array(["one two two", None, "three"]), pa.array(["two one three"]), pa.array(["three four"])]
    enc = library()
    for part in own:
        assert m.encode_texts(part, v, pattern).to_pylist() == [enc.encode_ordinary(t or "") for t in part.to_pylist()]
    # "one", " two", "three"; then "two", " one", " three"; then " four"
    assert seen == [12, 13, 5]


def test_a_batch_that_failed_leaves_nothing():
    pattern, v = regex.compile(public_tokenizers.PATTERN), m.Vocabulary(PATH)
    v.gathered.add(["left", " over"])
    assert m.encode_texts(pa.array(["left alone"]), v, pattern).to_pylist() == [library().encode_ordinary("left alone")]


def test_texts_come_in_small_batches_where_asked(spark):
    """The pipeline's stages that carry texts write them so; the session's setting stays."""
    had = spark.conf.get(common.ARROW_ROWS)
    rows = F.arrow_udf(lambda x: pa.array([len(x)] * len(x), pa.int64()), "long")
    df = spark.range(0, 5000, 1, 1).select(rows("id").alias("n"))
    assert max(r.n for r in common.save(df, batch=common.TEXTS).collect()) == common.TEXTS
    assert max(r.n for r in common.save(df).collect()) == 5000 and spark.conf.get(common.ARROW_ROWS) == had

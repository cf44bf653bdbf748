from __future__ import annotations

import random
from collections import defaultdict
from functools import cache
from itertools import product
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ordlake.llm import packing as m
from ordlake.llm.queries import op11_packing
from tests.llm.conftest import SCHEMA, prose, row

PATH = public_tokenizers.path("word_bpe_49k.json")


@cache
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def pieces_of(rows, length=2048):
    out = []
    for d, t in rows:
        ids = np.array(ids_of(t), "<u4")
        out += [(d, k, at, len(ids[at : at + length]), crc32(ids[at : at + length].tobytes())) for k, at in enumerate(range(0, len(ids), length))]
    return out


def check(rows, pieces, length):
    """All pieces once, in sequences that are gapless and not too long."""
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((r[:5] for r in rows), key=key) == sorted(pieces, key=key)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r[5]].append((r[6], r[3]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    return len(seqs)


def tuples(df):
    return [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in df.collect()]


def odd_texts():
    r = random.Random(5)
    marks = "aB9'!< |>_\t\n\x0b\x1c\x1f\x85\xa0​  ﻿́éͅÀŸſİıŉßΣσς中文ª²½٣🙂{}<|endoftext|>'s'LL"
    return ["".join(r.choice(marks) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["<|startoftext|> x<|endoftext|>y", "é É", "ΟΔΟΣ ΟΔΟΣ.", "don't I'LL we'Ve '", "x" * 5000 + " é" * 3000]


def test_ids_equal_the_library():
    encode = m.Encoder.at(PATH)
    texts = odd_texts()
    for part in (texts, texts[:7], *([t] for t in texts)):
        assert encode.encode(part) == [np.array(ids_of(t)[:-1], "<u4").tobytes() for t in part]


def test_query_table(spark, docs, texts, empty):
    pieces = m.token_pieces(docs, PATH)
    placed, told = m.pack(pieces)
    n = check(tuples(placed), pieces_of(texts), 2048)
    assert n == told["sequences"] >= told["bound"] and n <= told["bound"] + 1
    assert m.pack(m.token_pieces(empty, PATH))[0].count() == 0


@pytest.mark.parametrize("shard,length", [(20, 64), (1 << 14, 50)])
def test_exchange(spark, monkeypatch, shard, length):
    monkeypatch.setattr(m, "SHARD", shard)
    r = random.Random(4)
    rows = [(i, prose(r, r.choice([1, 3, 6, 9, 20, 40]))) for i in range(300)] + [(5, None), (5, ""), (None, "a b"), (5, None)]
    df = spark.createDataFrame([row(*x) for x in rows], SCHEMA).repartition(4)
    placed, told = m.pack(m.token_pieces(df, PATH, length), length)
    n = check(tuples(placed), pieces_of(rows, length), length)
    assert n == told["sequences"] and told["bound"] <= n <= told["bound"] * 1.02 + 2
    alone = sum(int(m.best_fit(x, length)[0].max()) + 1 for x in np.array_split(np.array([p[3] for p in pieces_of(rows, length) if p[3] < length]), 12))
    assert shard > 20 or (told["exchanges"] and n < alone + sum(p[3] == length for p in pieces_of(rows, length)))


def test_best_fit_equals_one_by_one():
    r = random.Random(2)
    for _ in range(60):
        length = r.choice([10, 37, 2048])
        sizes = np.array([r.randint(1, length - 1) if r.random() < 0.7 else length // 3 + 1 for _ in range(r.randint(1, 80))])
        room: list[int] = []
        for s in sorted(sizes.tolist(), reverse=True):
            fit = min((x for x in room if x >= s), default=None)
            if fit is None:
                room.append(length - s)
            else:
                room[room.index(fit)] -= s
        bins, _ = m.best_fit(sizes, length)
        assert sorted(np.bincount(bins, sizes).astype(int).tolist()) == sorted(length - x for x in room)
        assert m.lower_bound(np.bincount(sizes, minlength=length + 1), length) <= len(room)


def test_bound_is_below_every_packing():
    def least(sizes, length):
        return min(len(set(bins)) for bins in product(range(len(sizes)), repeat=len(sizes)) if max(np.bincount(bins, sizes)) <= length)

    r = random.Random(3)
    tight = 0
    for _ in range(40):
        length = r.choice([6, 10, 20])
        sizes = [r.randint(1, length) for _ in range(r.randint(1, 5))]
        bound, best = m.lower_bound(np.bincount(sizes, minlength=length + 1), length), least(sizes, length)
        assert bound <= best
        tight += bound == best
    assert tight > 30
    assert m.lower_bound(np.bincount([4, 4, 4], minlength=8), 7) == 3  # the sum alone says 2


def test_parts(monkeypatch):
    whole = m.Encoder.at(PATH).encode([text := "Some words, é and more\x1c! " * 300])
    monkeypatch.setattr(m, "PART", 100)
    assert "".join(m.parts_of(text)) == text
    assert b"".join(m.Encoder.at(PATH).encode(list(m.parts_of(text)))) == whole[0]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "b"])], names=["doc_id", "text"])
    got = [tuple(r.values()) for b in m._pieces(PATH, 64, False)(iter([batch])) for r in b.to_pylist()]
    assert got == pieces_of([(1, text), (2, "b")], 64)


def test_sequences_hold_the_ids(spark):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(40)]
    df = spark.createDataFrame([row(*x) for x in rows], SCHEMA)
    got = [list(r.ids) for r in m.sequences(df, PATH, 32).collect()]
    assert all(len(s) <= 32 for s in got) and sorted(sum(got, [])) == sorted(i for _, t in rows for i in ids_of(t))
    joined = [" ".join(map(str, s)) for s in got]
    assert all(any(" ".join(map(str, ids_of(t))) in s for s in joined) for _, t in rows if len(ids_of(t)) <= 32)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(tuples(op11_packing(spark, sf)), pieces_of(rows), 2048)

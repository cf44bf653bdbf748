from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ordlake.llm import suffix_dedup as m


def brute(texts):
    raw = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[p : p + m.LENGTH] for _, b in raw for p in range(len(b) - m.LENGTH + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - m.LENGTH + 1):
            if seen[b[p : p + m.LENGTH]] > 1:
                gone[p] += 1
                gone[p + m.LENGTH] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        out.append((i, len(b), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(path)
    got = m.remove_repeats(spark.read.parquet(path)).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == Counter(brute(texts))


def test_equals_brute_force(spark, texts, tmp_path):
    check(spark, texts, tmp_path)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_overlaps(spark, tmp_path, seed):
    """Strings just under and over the length, shifted edges, few letters, periods, copies inside one text."""
    r = random.Random(seed)
    base = "".join(r.choice("ab") for _ in range(1500))
    texts = [(0, base), (1, "q" * 450), (2, "xyz" * 150)]
    for i in range(3, 40):
        a, n = r.randrange(1200), r.choice([198, 199, 200, 201, 260, 336, 337, 500])
        texts.append((i, "".join(r.choice("cd") for _ in range(r.randrange(300))) + base[a : a + n] + "".join(r.choice("cd") for _ in range(r.randrange(300)))))
    texts.append((99, base[100:400] + "é" + base[100:400]))
    check(spark, texts, tmp_path)


def test_long_text_is_cut_with_overlap(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    t = "".join(r.choice("abcdefgh") for _ in range(4000))
    found = {}
    for block in (1 << 20, 700):
        monkeypatch.setattr(m, "BLOCK", block)
        got = [np.stack(x, axis=1) for x in ((p, g, a) for _, p, g, a in m.anchors([t.encode()]))]
        found[block] = {tuple(map(int, x)) for x in np.concatenate(got)}
    assert found[1 << 20] == found[700]


def test_merge_and_front_coding():
    r = random.Random(7)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(12)) for _ in range(r.randint(1, 60))) for _ in range(7)]
    coded = [m.front_code(np.array([list(x) for x in run], np.uint8)) for run in runs]
    merged = list(m.merge([m.decode(c, len(run), 12) for c, run in zip(coded, runs, strict=True)]))
    rows = [x for _, x, _ in merged]
    assert rows == sorted(x for run in runs for x in run)
    for (_, a, _), (_, b, shared) in zip(merged, merged[1:], strict=False):
        assert shared == next((i for i in range(12) if a[i] != b[i]), 12)


def test_empty(empty):
    assert m.remove_repeats(empty).count() == 0


def test_batches_over_several_files(spark, texts):
    """Rows of other partitions have numbers over 32 bits away; here one task reads all that were written, as with many small files."""
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = m.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).drop("kept").collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert Counter(tuple(r) for r in got) == Counter(brute(texts))

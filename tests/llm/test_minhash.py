from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np

from ordlake.llm import bytehash, minhash as m


def sets_of(texts):
    out = [None] * len(texts)
    sig = [None] * len(texts)
    for own, h, counts in bytehash.word_hashes([t.encode() for t in texts]):
        doc, key, weight = m.shingles(h, counts)
        value = m.signatures(doc, key, weight, len(own))
        cuts = np.searchsorted(doc, np.arange(len(own) + 1))
        for k, i in enumerate(own):
            out[i], sig[i] = (key[cuts[k] : cuts[k + 1]], weight[cuts[k] : cuts[k + 1]]), value[k]
    return out, sig


def brute(a, b):
    x, y = dict(zip(*map(np.ndarray.tolist, a), strict=True)), dict(zip(*map(np.ndarray.tolist, b), strict=True))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y))


def test_shingles_are_counted():
    words = "a b c d e a b c d e a b c d e f".split()
    sets, _ = sets_of([" ".join(words), "a b", "", "A, b"])
    expected = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    assert sorted(sets[0][1].tolist()) == sorted(expected.values())
    assert len(sets[1][0]) == 1 and len(sets[2][0]) == 0 and sets[1][0].tolist() == sets[3][0].tolist()


def test_estimate_and_exact_similarity():
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[k:] + ["w1 w2 w3 w4 w5"] * k) for k in (0, 1, 5, 20, 60)]
    sets, sig = sets_of(texts)
    for i, j in itertools.combinations(range(5), 2):
        exact = m.probability_jaccard(sets[i], sets[j])
        assert abs(exact - brute(sets[i], sets[j])) < 1e-9
        assert abs((sig[i] == sig[j]).mean() - exact) < 0.25


def test_clusters_equal_all_pairs(docs, texts):
    got = m.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    distinct = sorted({t or "" for _, t in texts})
    sets, _ = sets_of(distinct)
    parent = {t: t for t in distinct}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, j in itertools.combinations(range(len(distinct)), 2):
        if m.probability_jaccard(sets[i], sets[j]) >= 0.8:
            parent[root(distinct[i])] = root(distinct[j])
    size = Counter(root(t or "") for _, t in texts)
    best = {}
    for i, t in texts:
        k = root(t or "")
        best[k] = min(best.get(k, (i is not None, i or 0)), (i is not None, i or 0))
    by_id = {i: t or "" for i, t in texts if i is not None}
    for r in got:
        if r.doc_id is not None:
            k = root(by_id[r.doc_id])
            assert r.cluster_size == size[k]
            assert r.cluster_id == (best[k][1] if best[k][0] else None)
    assert sum(r.kept for r in got) == len(size)


def test_drop(docs, empty):
    kept = m.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == m.near_duplicates(docs).filter("kept").count()
    assert m.near_duplicates(empty).count() == 0 and m.drop_near_duplicates(empty).count() == 0


def test_components(spark):
    from ordlake.llm.common import components

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(1, 41)}) == 1 and got[100] == got[70] == got[50] != got[1]
    assert all(got[c] == c for c in set(got.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_inside_a_family_of_one_template(spark, tmp_path):
    base, pairs = " ".join(f"t{i}" for i in range(60)), 60
    tail = lambda i, k: " ".join(f"own{i}x{j}" for j in range(k))
    texts = [f"{base} {tail(i, 8)}" for i in range(600)]
    texts += [f"{base} {tail(i, 4)} {tail(10_000 + i, 4)}" for i in range(pairs)]
    sets, _ = sets_of(texts)
    assert m.probability_jaccard(sets[0], sets[1]) < 0.8 <= m.probability_jaccard(sets[0], sets[600])
    path = str(tmp_path / "family.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r for r in m.near_duplicates(spark.read.parquet(path)).collect()}
    sizes = Counter(r.cluster_size for r in got.values())
    assert sum(got[i].cluster_id == got[600 + i].cluster_id for i in range(pairs)) == pairs
    assert sizes == {1: 600 - pairs, 2: 2 * pairs}


def test_clusters_of_hard_families_equal_all_pairs(spark, tmp_path):
    """Families whose similarities lie around 0.8, so that most links are near the threshold."""
    r, texts = random.Random(11), []
    for f in range(4):
        base = [f"f{f}w{i}" for i in range(160)]
        for _ in range(70):
            own = list(base)
            for _ in range(r.randint(1, 4)):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(own))
    sets, _ = sets_of(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if i // 70 == j // 70 and m.probability_jaccard(sets[i], sets[j]) >= 0.8]
    for i, j in links:
        parent[root(i)] = root(j)
    path = str(tmp_path / "hard.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    got = {x.doc_id: x.cluster_id for x in m.near_duplicates(spark.read.parquet(path)).collect()}
    held = sum(got[i] == got[j] for i, j in links) / len(links)
    assert 2000 < len(links) < 4 * 70 * 69 / 2 and held >= 0.999
    assert len({root(i) for i in range(len(texts))}) <= len(set(got.values())) <= len({root(i) for i in range(len(texts))}) + 1

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ordlake.llm import prefix_trie as m

SCHEMA = "conv_id long, turn long, role string, text string, depth long, size string"


def brute(turns):
    """Every prefix of every rebuilt conversation, one by one."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    own = {c: [x[2:] for x in sorted(t, key=lambda x: (*x[:2], digest(*x[2:])))] for c, t in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(nodes, key=len, reverse=True):
        c = nodes[p]
        below = [out[k] for k in kids[p]]
        saved = (len(c) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(b[6] for b in below)
        ends = ",".join(str(i) for i in sorted(c) if len(built[i]) == len(p))
        out[p] = (min(c), len(p), min(nodes[p[:-1]]) if p else None, len(c), len(below), sum(b[5] for b in below) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: r[:2])


def trie(spark, turns):
    rows = [(*t, 5, "x") for t in turns]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in m.prefix_trie(df).collect()), key=lambda r: r[:2])


def conversations(seed, n, length):
    r = random.Random(seed)
    out = []
    for c in range(n):
        copy = [t for t in out if t[0] == r.randrange(max(1, c))] if r.random() < 0.4 else []
        if copy:  # a copy, now and then with another end
            turns = [t[1:] for t in copy][: r.randint(1, 2 * len(copy))]
            turns += [(99 + i, "user", r.choice("ab")) for i in range(r.randint(0, 2))] if r.random() < 0.5 else []
        else:
            turns = [(i if i else None, r.choice(["user", "assistant", None]), r.choice(["a", "bé", None, "", f"only {c}"])) for i in range(r.randint(1, length))]
        if r.random() < 0.95:  # some first conversations of a group are absent
            out += [(c, *t) for t in turns]
    return out


@pytest.mark.parametrize("seed,n,length,stride", [(1, 120, 6, 8), (2, 60, 25, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, n, length, stride):
    monkeypatch.setattr(m, "STRIDE", stride)
    monkeypatch.setattr(m, "BLOCK", 4)
    turns = conversations(seed, n, length)
    assert trie(spark, turns) == brute(turns)


def test_hot_node_long_copies_and_gaps(spark):
    opening = [(i, "user", f"turn {i}") for i in range(12)]
    turns = [(c, *t) for c in range(10, 150) for t in opening]  # all alike
    turns += [(c, *t) for c in (1000, 1005) for t in [(i, "user", f"long {i}") for i in range(60)]]
    turns += [(4001, 0, "user", "short and without a first one"), (None, 0, "user", "nobody's"), (12, 40, "user", "more"), (13, 40, "user", "other")]
    assert trie(spark, turns) == brute(turns)


def test_empty_and_single(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(7, None, None, None)]) == brute([(7, None, None, None)])

"""Joins of names send nothing that grows through the driver; the subsequence's bound loses no pair."""

from __future__ import annotations

import contextlib
import io
import random

import numpy as np

from ordlake.operators import similar
from ordlake.plans import similarity as plans


def ran(df) -> str:
    """The plan as it was run."""
    df.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    assert "isFinalPlan=true" in out.getvalue()
    return out.getvalue()


def test_names_are_never_broadcast(spark):
    """All tables here are far below the broadcast threshold, as the rows of a large one are before they are exploded."""
    known = spark.createDataFrame([(i, f"завод {i % 7} кабель {i}", f"завод {i % 7} кабель {i}") for i in range(60)], "kid long, name string, key string")
    probes = known.selectExpr("kid AS pid", "substring(key, 1, 14) AS key")
    df = similar.similar_organisations(probes, "pid", known, "kid", "name", "key", 0.82, 0.88, 8)
    assert "Broadcast" not in ran(df) and df.count() > 60
    assert "Broadcast" not in ran(plans.org_similar(spark, "/root/testdata/sf0.001"))
    words = known.selectExpr("kid % 3 AS g", "name")
    assert "Broadcast" not in ran(similar.drop_contained(words, "g", "name", 8))


def test_bound_of_the_subsequence():
    r = random.Random(3)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    many = [chr(c) for c in range(0x400, 0x400 + 400)]
    for letters, exact in (("abcdefgh ij", True), (many, False)):
        left, right = ([word(letters, r.choice([1, 5, 17, 40, 63, 64, 65, 90])) for _ in range(120)] for _ in range(2))
        i, j = (k.ravel() for k in np.meshgrid(np.arange(120), np.arange(120)))
        got = similar.subsequence_bound(left, right)(i, j)
        want = similar.common_subsequence([left[k] for k in i], [right[k] for k in j])
        long = np.array([max(len(left[p]), len(right[q])) > 64 for p, q in zip(i, j, strict=True)])
        assert (got[long] == -1).all() and (got[~long] >= want[~long]).all()
        assert not exact or (got[~long] == want[~long]).all()


def test_bits_of_common_characters_bound_what_is_shared():
    r = random.Random(4)
    names = ["".join(r.choice("абвгдежзиклмнопрст 🙂xyz") for _ in range(r.choice([1, 8, 20, 300]))) for _ in range(80)]
    own, there, lost = similar.common_bits(names, names[::2])
    for i, a in enumerate(names):
        for j, b in enumerate(names[::2]):
            shared = sum(min(a.count(c), b.count(c)) for c in set(a))
            assert int(np.bitwise_count(own[i] & there[j])) + lost[i] >= shared

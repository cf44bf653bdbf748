"""Joins by ratio and containment against all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from ordlake.operators import similar
from ordlake.plans import similarity as plans


def names(seed, n):
    r = random.Random(seed)
    stems = ["ромашка", "спецкабель", "завод кабель", "abc", "ab", "северный путь", "аааа", "бббб бб"]
    out = set()
    while len(out) < n:
        s = list(r.choice(stems) + r.choice(["", " плюс", " 2", "-сервис"]))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(s))
            s[at : at + r.randint(0, 1)] = r.choice(["", "а", "б", "x", s[at] * 2])
            s = s or ["я"]
        out.add("".join(s).strip())
    return sorted(out)


def frame(spark, xs, column):
    return spark.createDataFrame([(x,) for x in xs], f"{column} string")


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.72, 0.82, 0.9])
def test_ratio_pairs(spark, least):
    a, b = [*names(1, 90), "", None, "q"], [*names(2, 90), "", None, "q"]
    got = {(r[0], r[1]): r[2] for r in similar.ratio_pairs(frame(spark, a + a[:5], "x"), frame(spark, b, "y"), least).collect()}
    want = {(p, q): ratio(p, q) for p in a for q in b if p and q and ratio(p, q) >= least}
    assert got == want and len(got) > 60


def test_contained_pairs(spark):
    a, b = [*names(3, 80), "a", "б", ""], [*names(4, 80), "a"]
    got = sorted(tuple(r) for r in similar.contained_pairs(frame(spark, a, "x"), frame(spark, b, "y")).collect())
    assert got == sorted({(p, q) for p in a for q in b if p and len(p) < len(q) and p in q}) and len(got) > 20


def test_organisations(spark):
    a, b = list(enumerate(names(5, 60) + names(5, 10))), list(enumerate([*names(6, 70), *names(5, 20), *["ромашка"] * 12, ""]))
    probes = spark.createDataFrame(a, "pid long, key string")
    known = spark.createDataFrame([(i, x, f"ООО {x}") for i, x in b], "kid long, key string, name string")
    got = sorted(tuple(r) for r in similar.similar_organisations(probes, "pid", known, "kid", "name", "key", 0.82, 0.88, 8).collect())
    want = []
    for i, x in a:
        scored = []
        for j, y in b:
            s = 1.0 if x == y else ratio(x, y)
            if x != y and y and (x in y or y in x):
                s = max(s, 0.88)
            if y and s >= 0.82:
                scored.append((-round(s, 3), f"ООО {y}", j))
        want += [(i, j, n, -s) for s, n, j in sorted(scored)[:8]]
    assert got == sorted(want) and len(got) > 150


def test_nearest_and_lookup(spark):
    marks, brands = [*names(7, 80), "abcd", "abce", "xbcd"], [*names(8, 60), "abcf"]
    known = frame(spark, brands, "brand").selectExpr("brand", "lower(brand) AS k")
    got = {r.m: r.brand for r in similar.nearest_known(frame(spark, marks, "m"), "m", known, "brand", "k", 0.82).collect()}
    want = {}
    for m in set(marks):
        ok = [(-ratio(m, b), b) for b in brands if len(m) >= 4 and abs(len(m) - len(b)) <= 3 and (len(m) > 4 or b[:2] == m[:2]) and ratio(m, b) >= 0.82]
        if ok:
            want[m] = min(ok)[1]
    assert got == want and len(got) > 20


def test_snap_prefix(spark):
    marks, brands = [*names(9, 60), "АБВ", "абвг"], [*names(10, 50), "АБВГ", "я"]
    got = {r.p: r.brand for r in similar.snap_prefix(frame(spark, marks, "p"), "p", frame(spark, brands, "brand"), "brand", 0.82).collect()}
    want = {}
    for m in set(marks):
        p = m.lower()
        ok = []
        for b in brands:
            k = b.lower()
            s = 1.0 if p.startswith(k) or k.startswith(p) else ratio(p, k)
            if len(k) >= 2 and s >= 0.82:
                ok.append((-s, -len(k), b))
        if ok:
            want[m] = min(ok)[2]
    assert got == want and len(got) > 20


def test_drop_contained(spark):
    rows = [(i % 3, x) for i, x in enumerate(names(11, 60) + ["эвнг(а)-ls 3х2", "кунрс эвнг(а)-ls 3х2", "u/utp", "u/utp cat 5e", "внутри конца слова нет", "конца слова"])] + [(0, None), (0, ""), (1, "u/utp"), (1, "u/utp 4")]
    rows += [(2, "flexicore 100"), (2, "flexicore 100 нг"), (2, "flexi")]
    df = spark.createDataFrame(rows, "doc int, mark string")
    got = sorted(tuple(r) for r in similar.drop_contained(df, "doc", "mark", 8, F.startswith(F.col("name"), F.lit("flexicore"))).collect())
    exempt = lambda x: x.startswith("flexicore")
    kept = lambda g, x: exempt(x) or not any(h == g and y and not exempt(y) and len(y) > len(x) and (y.startswith(x) or (x in y and len(x) >= 8)) for h, y in rows)
    assert got == sorted({(g, x) for g, x in rows if x and kept(g, x)}) and len(got) < len({r for r in rows if r[1]})
    assert (2, "flexi") in got


def table(name, *columns):
    return duckdb.sql(f"SELECT {', '.join(columns)} FROM '/root/testdata/sf0.001/{name}.parquet'").fetchall()


def test_queries_equal_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    marks = {plans.altered_name(n, k) for k, n in table("part", "p_partkey", "p_name")}
    brands = sorted({n for (n,) in table("part", "p_name")})
    want = {}
    for m in marks:
        key, base = alike(m), alike(m.split("нг(")[0])
        near = [(-ratio(key, alike(b)), b) for b in brands if len(key) >= 4 and abs(len(key) - len(alike(b))) <= 3 and ratio(key, alike(b)) >= 0.82]
        found = [(b, "exact") for b in brands if alike(b) == key] or [(b, "base") for b in brands if alike(b) == base] or ([(min(near)[1], "near")] if near else [(None, None)])
        want[m] = found[0]
    got = {r.name: (r.brand, r.how) for r in plans.lexicon_lookup(spark, sf).collect()}
    assert got == want and {h for _, h in got.values()} >= {"exact", "base", "near"}

    firsts = {plans.altered_name(n.split(" ")[0], k % 2) for k, n in table("part", "p_partkey", "p_name")}
    known = {n.split(" ")[0] for n in brands}
    best = {}
    for p in firsts:
        ok = [(-1.0 if p.startswith(k) or k.startswith(p) else -ratio(p, k), -len(k), k) for k in known]
        ok = [x for x in ok if -x[0] >= 0.82]
        if ok:
            best[p] = (min(ok)[2], -min(ok)[0])
    assert {r.prefix: (r.brand, r.score) for r in plans.brand_ratio_snap(spark, sf).collect()} == best and best

    customers, suppliers = plans.organisations(spark, sf)
    known, probes = customers.collect(), suppliers.collect()
    rows = []
    for a in probes:
        scored = []
        for b in known:
            s = 1.0 if a.org_key == b.org_key else ratio(a.org_key, b.org_key)
            if s < 1 and (a.org_key in b.org_key or b.org_key in a.org_key):
                s = max(s, 0.88)
            if a.org_key and b.org_key and s >= 0.82:
                scored.append((-round(s, 3), b.name, b.org_id))
        rows += [(a.org_id, j, n, -s) for s, n, j in sorted(scored)[:8]]
    got = sorted((r.org_id, r.similar_id, r.name, r.score) for r in plans.org_similar(spark, sf).collect())
    assert got == sorted(rows) and got


def alike(x):
    return "".join(x.strip().lower().replace("ё", "е").replace("×", "х").replace("x", "х").split())


@pytest.mark.parametrize("least", [0.6, 0.82])
def test_bounds_lose_no_pair_in_blocks(spark, least, monkeypatch):
    """Long names whose bits collide, signs beyond the first plane, repeats, several blocks; only near pairs come to the subsequence."""
    r = random.Random(9)
    stems = ["".join(r.choice("абвгдежзик 🙂") for _ in range(n)) for n in (3, 9, 30, 120, 300, 700)]
    edit = lambda s: "".join(r.choice(["", c * 2, "x"]) if r.random() < 0.12 else c for c in s) or "y"
    a, b = ([edit(r.choice(stems)) for _ in range(60)] for _ in range(2))
    left, right = sorted(set(a), key=len), sorted(set(b), key=len)
    found = {(left[i], right[j]) for p, q in similar.likely(left, right, least) for i, j in zip(p, q, strict=True)}
    want = {(p, q): ratio(p, q) for p in left for q in right if ratio(p, q) >= least}
    assert want.keys() <= found and len(want) > 100
    subsequence = similar.common_subsequence([p for p, _ in want], [q for _, q in want]).tolist()
    assert all(2 * m / (len(p) + len(q)) >= want[p, q] - 1e-9 for m, (p, q) in zip(subsequence, want, strict=True))
    monkeypatch.setattr(similar, "BLOCK", 16)
    got = {(x[0], x[1]): x[2] for x in similar.ratio_pairs(frame(spark, a, "x"), frame(spark, b, "y"), least).collect()}
    assert got == want | {(p, p): 1.0 for p in set(a) & set(b)}


def test_containment_meets_few_names(spark):
    """Names of like words meet by their rarest run, not by pairs of letters: of 90,000 pairs of names few are compared."""
    a, b = ([f"общество {x * 7919 % 100000:05d} кабель" for x in range(k, k + 300)] for k in (0, 150))
    short, long = frame(spark, [x[:-2] for x in a], "x"), frame(spark, b, "y")
    assert sorted(tuple(r) for r in similar.contained_pairs(short, long).collect()) == sorted((x[:-2], x) for x in a if x in set(b))
    assert similar._sharing_rarest(short, long, 6).count() < 1000

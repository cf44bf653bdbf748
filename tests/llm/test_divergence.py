from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from ordlake.llm import divergence as m

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    """The contract, term by term."""
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = WORD.findall((text or "").translate(LOWER))
        n[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    f = lambda p, q: (p - q) * (p - q) // q
    for lang in docs:
        kept = [w for w, k in docs[lang].items() if k >= 3]
        own = {s: c for (g, s), c in n.items() if g == lang}
        total = sum(own.values(), Counter())

        def p(c, kept=kept):
            size = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (size + len(kept)) for w in kept}

        ps, q = {s: p(c) for s, c in own.items()}, p(total)
        for s in own:
            pairs = [(sum(f(ps[s][w], ps[t][w]) for w in kept), t) for t in own if t != s]
            told = [(f(ps[s][w], q[w]), w) for w in kept if own[s][w] and ps[s][w] > q[w]]
            for part, items, last in (("pair", pairs, None), ("term", told, 200)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(items[:last], 1)]
    return sorted(out)


def audited(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in m.audit(df).collect())


def table(n, sources, seed):
    r = random.Random(seed)
    words = [f"{r.choice('aäéßZQ中')}{r.choice('bcdxyz')}{k}"[:2] + "qwertyuiopas"[k % 12] + "zxcvb"[k % 5] * (k % 4) for k in range(700)]
    out = []
    for i in range(n):
        s = 0 if r.random() < 0.33 else r.randrange(sources)
        lang = r.choice(["en", "de", "en"])
        ws = [words[min(int(r.paretovariate(0.6)) + s * 3, 699)] for _ in range(r.randint(0, 60))]
        out.append((" ".join(w.title() if r.random() < 0.2 else w for w in ws) + r.choice(["", " 12 x-y_z", "\n\0don't"]), lang, f"s{s}é"))
    return out


@pytest.mark.parametrize("sources,width", [(7, 2), (9, 64)])
def test_equals_brute_force(spark, monkeypatch, sources, width):
    monkeypatch.setattr(m, "SOURCES", width)  # several blocks of sources
    monkeypatch.setattr(m, "BLOCK", 50)
    rows = table(400, sources, sources) + [(None, None, None), (None, "xx", "a"), ("", "xx", "b"), ("one", "xx", "c"), ("one one", "xx", "c"), ("zz", None, "only"), ("w " * 50, "en", None)]
    df = spark.createDataFrame([(i, *x, "more") for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").repartition(5)
    got = audited(df)
    assert got == brute(rows) and len(got) > 500


def test_no_kept_terms_and_no_rows(spark, empty):
    df = spark.createDataFrame([("one two", "en", "a"), ("one", "en", "b")], "text string, lang string, source string")
    assert audited(df) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert m.audit(empty).count() == 0


def test_terms_of_long_texts(monkeypatch):
    text = ("Ab cd-eéf " * 500 + "x" * 90 + " 1 end").encode()
    whole = [w for part in m.terms(text) for w in part]
    for size in (1, 7, 64):
        monkeypatch.setattr(m, "PIECE", size)
        assert [w for part in m.terms(text) for w in part] == whole
    assert [w.decode() for w in whole] == WORD.findall(text.decode().translate(LOWER))


def test_sketch_never_underestimates(spark):
    rows = spark.range(4000).selectExpr("xxhash64(id % 1500) AS h", "1L AS docs").repartition(4)
    test = m.possibly_kept(spark, m.sketch(rows, 1 << 14))
    judged = rows.groupBy("h").count().withColumn("stays", test("h"))
    assert judged.filter("count >= 3 AND NOT stays").count() == 0
    assert judged.filter("count < 3 AND stays").count() < 30

from __future__ import annotations

import math
import random
import re

from ordlake.llm import license_scan as m

from .conftest import prose


def words(text):
    return re.findall(m.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts):
    """Every template at every start of every text: words, base places, base labels, labels, score."""
    split = [words(t) for t in texts]
    idf = {w: math.log((len(texts) + 1) / (sum(w in s for s in map(set, split)) + 1)) + 1 for _, _, ws, _ in m._templates() for w in ws}
    out = []
    for own in split:
        base, labels, score = [], set(), 0.0
        held = {label for kind, label, ws, _ in m._templates() if kind == "key" and any(own[i : i + len(ws)] == ws for i in range(len(own)))}
        for kind, label, ws, needs in m._templates():
            for at in range(-len(ws), len(own)):
                share = sum(idf[w] for i, w in enumerate(ws) if 0 <= at + i < len(own) and own[at + i] == w) / sum(map(idf.get, ws))
                if kind == "base" and own[max(at, 0) : at + len(ws)] == ws and at >= 0:
                    base.append((at, label))
                elif kind != "notice" or share < m.COVERAGE or not set(needs) <= held:
                    continue
                labels.add(label)
                score = max(score, share)
        out.append((len(own), sorted(at for at, _ in base), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return out


def same(got, texts):
    for r, (n, starts, base, labels, score) in zip(got, brute(texts), strict=True):
        assert (r.n_words, r.places, r.base_labels, r.labels) == (n, len(starts), base, labels), r.text
        assert (r.first_word, r.last_word) == ((starts[0], starts[-1]) if starts else (None, None))
        assert abs(r.score - score) < 1e-9


def test_equals_brute_force(docs, texts):
    got = m.scan(docs).select("text", "licence.*").collect()
    assert len(got) == len(texts)
    same(got, [r.text for r in got])


def test_damaged_notices_equal_brute_force(spark):
    r, texts = random.Random(5), []
    for k in range(150):
        own = r.choice(m.NOTICES)[1].split()
        for _ in range(r.randint(0, len(own) // 3 + 1)):
            own[r.randrange(len(own))] = r.choice(["x", "the", "license", "public"])
        if r.random() < 0.2:
            del own[r.randrange(len(own))]
        texts.append(f"{prose(r, r.randint(0, 9))} {' '.join(own)} {r.choice(['', 'All rights reserved. ' * 3, 'cc by'])}{prose(r, 3)}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = m.scan(df).select("text", "licence.*").collect()
    same(got, texts)
    assert 30 < sum(g.labels != "" for g in got) < 150


def test_a_column_of_the_result_s_name_stays(spark):
    r = m.scan(spark.createDataFrame([("cc by", "mine", 3)], "text string, licence string, __words int")).first()
    assert r.licence == "mine" and r["__words"] == 3 and r.licence_.labels == "cc-by"


def test_notices_need_their_key_phrase(spark):
    rows = [(1, "Released under the MIT License"), (2, "Released under the BLUE License"), (3, "cc by cc by CC-BY all Rights reserved"), (4, "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files"), (5, "general public\nlicense"), (6, "İcc byſ cc by")]
    got = {r.doc_id: r.licence for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[2].labels == "" and got[4].labels == "mit"
    assert (got[3].places, got[3].first_word, got[3].last_word, got[3].base_labels) == (4, 0, 6, "cc-by,reserved")
    assert got[5].base_labels == "gpl" and got[6].places == 1


def test_empty_table_and_other_columns(empty, docs):
    assert m.scan(empty).count() == 0
    assert set(docs.columns) < set(m.scan(docs).columns)


def test_plan_is_native(docs):
    plan = m.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

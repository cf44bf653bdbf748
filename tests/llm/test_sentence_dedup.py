from __future__ import annotations

import random
import re
from collections import Counter

from ordlake.llm import bytehash, sentence_dedup as m

from .conftest import prose


def plain_sentences(text: str) -> list[tuple[int, tuple[str, ...]]]:
    """(first character, words) of each sentence, word by word."""
    found = [(x.start(), x.end(), "".join(c.lower() if "A" <= c <= "Z" else c for c in x.group())) for x in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    groups: list[list] = []
    for k, (a, b, w) in enumerate(found):
        gap = text[found[k - 1][1] : a] if k else ""
        if not k or re.search(r"[.!?][ \t\n\x0b\x0c\r]|\n", gap):
            groups.append([])
        groups[-1].append((a, w))
    out = []
    for g in groups:
        by = [int(bytehash.mix(bytehash.words(w.encode())[3] ^ m.np.uint64(0xA0761D6478BD642F))[0]) for _, w in g]
        least = lambda i: all(by[i] <= by[j] for j in range(max(0, i - m.NEAR), min(len(by), i + m.NEAR + 1)) if j != i)
        at = [0] + [i + 1 for i in range(len(g) - 1) if len(g) > m.LONG and least(i)]
        out += [(g[i][0], tuple(w for _, w in g[i:j])) for i, j in zip(at, [*at[1:], len(g)], strict=True)]
    return out


def brute(texts):
    seen, out = set(), []
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0))
    for k in order:
        text = texts[k][1] or ""
        units = plain_sentences(text)
        gone = set()
        for j in range(len(units) - m.SPAN + 1):
            key = tuple(w for _, w in units[j : j + m.SPAN])
            gone |= set(range(j, j + m.SPAN)) if key in seen else set()
            seen.add(key)
        bounds = [a for a, _ in units] + [len(text)]
        kept = text[: bounds[0]] + "".join(text[bounds[i] : bounds[i + 1]] for i in range(len(units)) if i not in gone)
        out.append((texts[k][0], kept, len(gone)))
    return out


def test_equals_brute_force(docs, texts):
    got = m.remove_repeated_spans(docs).collect()
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got) == Counter(brute(texts))
    assert sum(r.n_removed > 0 for r in got) >= 8


def test_sentences_of_random_texts_equal_plain_ones(monkeypatch):
    for part in (1 << 20, 40):
        monkeypatch.setattr(m, "PART", part)
        for seed in range(150):
            r = random.Random(seed)
            text = "".join(r.choice(["ab", "c", " ", ". ", ".", "\n", "!? ", "é", "xyz ", "q w e r t ", "🙂"]) for _ in range(r.randint(0, 90)))
            _, first, _, _ = m.sentences([text.encode()])
            assert [len(text.encode()[:a].decode()) for a in first] == [a for a, _ in plain_sentences(text)], text


def test_shared_passage_is_removed(docs, texts):
    got = {r.doc_id: r for r in m.remove_repeated_spans(docs).collect()}
    assert got[100].n_removed == 0 and all(got[100 + i].n_removed > 0 for i in range(1, 6))


def test_a_passage_of_one_long_sentence_is_removed(spark):
    r = random.Random(6)
    for k in range(4):
        passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
        rows = [(i, f"{prose(r, 40)[:-1]} {passage} {prose(r, 40)}") for i in range(3)] + [(9, prose(r, 300))]
        got = {x.doc_id: x for x in m.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[0].n_removed == got[9].n_removed == 0, k
        assert all(got[i].n_removed > 0 and len(got[i].text) < len(rows[i][1]) - 60 for i in (1, 2)), k


def test_empty(empty):
    assert m.remove_repeated_spans(empty).count() == 0

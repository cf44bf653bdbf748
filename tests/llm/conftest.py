from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, score double, hash string, mix string, again int"
_PARTS = ["an", "er", "le", "ti", "on", "th", "ou", "é", "ñ", "ü"]


def prose(r: random.Random, n: int) -> str:
    words = ["".join(r.choice(_PARTS) for _ in range(r.randint(1, 5))) for _ in range(n)]
    out, at = [], 0
    while at < n:
        k = r.randint(4, 14)
        out.append(" ".join(words[at : at + k]).capitalize() + ".")
        at += k
    return " ".join(out)


def row(i, text):
    return (i, text, "en", f"src{(i or 0) % 3}", len(text or ""), "x", "y", 1.5, "z", "m", 7)


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    r = random.Random(3)
    out: list[tuple[int | None, str | None]] = [(i, prose(r, r.randint(20, 160))) for i in range(60)]
    passage = prose(r, 60)
    out += [(100 + i, f"{prose(r, 30)} {passage} {prose(r, 30)}") for i in range(6)]
    out += [(200 + i, out[3][1]) for i in range(4)]
    for i in range(8):  # near copies: one word of many is changed
        words = out[5][1].split()
        words[r.randrange(len(words))] = f"changed{i}"
        out.append((300 + i, " ".join(words)))
    out += [(400, None), (401, ""), (402, " \n\n "), (403, "a"), (404, "ab" * 700), (405, "..!?.. \n"), (406, prose(r, 4000)), (407, "x y " * 400), (None, out[7][1]), (None, None), (408, "Ünïcode 🙂 " * 40), (409, "Ünïcode 🙂 " * 40)]
    out += [out[3], out[3], out[9]]
    out += [(500 + i, f"{prose(r, 12)} write to ab.c{i}@mail.example.com or +1 (663) 555-68{i:02d}, host 10.0.0.{i}. All rights reserved.\nLicensed under CC BY-NC 4.0.") for i in range(5)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    """The texts as a written table with columns whose names clash with those that operators use."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([row(*t) for t in texts], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)

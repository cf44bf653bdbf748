"""Operator 1: licence scan through a positional rare-token index, with DataFrame functions only.

Document frequencies of all licence words are counted over the whole corpus. Of each notice the words of highest IDF
are posted in an index, with their place in the notice: as many as it takes for every match of COVERAGE to hold two
of them. A file's posted words are looked up; each gives the place where the notice would have to start, and the
postings are intersected: only starts on which two words agree by relative position are checked against the whole
notice, weighted by IDF. A label holds only if its mandatory key phrases stand in the file too. Phrases that must
stand whole (the contract's and the key phrases) are looked up by their rarest word. Everything about one file
happens in its own row: nothing but the word counts is shuffled.

Defined results: a null text is empty; score is the greatest share of a labelled phrase's or notice's weight that
stands in place, 0 without labels; files without words have no labels, score 0 and null first_word and last_word;
every place of a phrase counts, also in repeated lines; repeated rows are scanned one by one; an empty table gives
an empty result; other columns are untouched, and where the input has a column of the result's name already, the
result's name gets underscores until it is free.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases of the contract, and opening words of public licence notices with the phrases they need.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
NOTICES = [
    ("agpl", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["www apache org"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose"]),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
#: The share of a notice's IDF weight that must stand in place.
COVERAGE = 0.7
_SHIFT = 40


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), 0)


def _templates() -> list[tuple[str, str, list[str], list[str]]]:
    """(kind, label, words, key phrases): contract phrases, key phrases, notices."""
    keys = sorted({k for _, _, own in NOTICES for k in own})
    out = [("base", label, phrase.split(), []) for label, phrase in BASE]
    out += [("key", k, k.split(), []) for k in keys]
    return out + [("notice", label, text.split(), own) for label, text, own in NOTICES]


def document_frequency(words: DataFrame) -> dict[str, float]:
    """IDF of every licence word, from all rows in one job; one number for each word comes back."""
    vocabulary = sorted({w for _, _, ws, _ in _templates() for w in ws})
    own = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    seen = words.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("w"))  # the empty word stands for the row
    df = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}


def _posted(words: list[str], idf: dict[str, float]) -> list[int]:
    """Places of the rarest words, so many that words which bear COVERAGE of the weight hold two of them."""
    order = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))
    weight = [idf[w] / sum(map(idf.get, words)) for w in words]
    for n in range(2, len(order)):
        if sum(weight[i] for i in order[1:n]) > 1 - COVERAGE + 1e-9:
            return order[:n]
    return order


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "licence") -> DataFrame:
    """docs with a struct<n_words, places, first_word, last_word, base_labels, labels, score>."""
    idf = document_frequency(docs.select(words_of(F.col(text_col)).alias("words")))
    templates = _templates()
    number = {("key", label): i for i, (kind, label, _, _) in enumerate(templates) if kind == "key"}
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (kind, _, ws, _) in enumerate(templates):
        for i in _posted(ws, idf) if kind == "notice" else [max(range(len(ws)), key=lambda i, ws=ws: (idf[ws[i]], -i))]:
            index.setdefault(ws[i], []).append((t, i))
    notices = min(t for t, x in enumerate(templates) if x[0] == "notice")  # the templates from here on

    posting = lambda t, i: F.struct(F.lit(t).cast("long").alias("t"), F.lit(i).alias("i"))
    postings = F.create_map(*[x for w, ps in sorted(index.items()) for x in (F.lit(w), F.array(*[posting(t, i) for t, i in ps]))])
    total = [sum(idf[w] for w in ws) for _, _, ws, _ in templates]
    lexicon = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(idf[w] / total[t]).alias("weight")) for i, w in enumerate(ws)]) for t, (_, _, ws, _) in enumerate(templates)])
    sizes = F.array(*[F.lit(len(ws)) for _, _, ws, _ in templates])
    needs = F.array(*[F.array(*[F.lit(number["key", k]) for k in own]).cast("array<int>") for _, _, _, own in templates])
    labels = F.array(*[F.lit(label) for _, label, _, _ in templates])
    kinds = F.array(*[F.lit(kind) for kind, _, _, _ in templates])

    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), words_of(F.col(text_col)).alias("__words"))
    places = F.array_compact(F.transform("__words", lambda w, i: F.when(w.isin(sorted(index)), i)))
    tagged = tagged.withColumn("__places", places)
    # a candidate is template * 2^40 + start + 2^20; the start may lie before the file's first word
    starts = F.flatten(F.transform("__places", lambda at: F.transform(F.element_at(postings, F.get("__words", at)), lambda p: p["t"] * (1 << _SHIFT) + at - p["i"] + (1 << 20))))
    tagged = tagged.withColumn("__all", F.sort_array(starts))
    agreed = lambda c, i: (c < notices << _SHIFT) | ((i > 0) & (F.get("__all", F.greatest(i - 1, F.lit(0))) == c))
    tagged = tagged.withColumn("__starts", F.array_distinct(F.filter("__all", agreed)))

    def judge(c: Column) -> Column:
        t = F.shiftright(c, _SHIFT).cast("int")
        at = (c.bitwiseAND((1 << _SHIFT) - 1) - (1 << 20)).cast("int")
        same = lambda p: (at + p["i"] >= 0) & (F.get("__words", F.greatest(at + p["i"], F.lit(0))) == p["w"])
        words = F.get(lexicon, t)
        hits = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("weight")), lambda a, p: F.when(same(p), F.struct((a["n"] + 1).alias("n"), (a["weight"] + p["weight"]).alias("weight"))).otherwise(a))
        return F.struct(t.alias("t"), at.alias("at"), hits["n"].alias("n"), F.least(hits["weight"], F.lit(1.0)).alias("weight"))

    tagged = tagged.withColumn("__found", F.transform("__starts", judge))
    kind = lambda x: F.get(kinds, x["t"])
    whole = lambda x: x["n"] == F.get(sizes, x["t"])
    tagged = tagged.withColumn("__base", F.filter("__found", lambda x: (kind(x) == "base") & whole(x)))
    tagged = tagged.withColumn("__keys", F.array_distinct(F.transform(F.filter("__found", lambda x: (kind(x) == "key") & whole(x)), lambda x: x["t"])))
    notice = F.filter("__found", lambda x: (kind(x) == "notice") & (x["weight"] >= COVERAGE) & (F.size(F.array_except(F.get(needs, x["t"]), F.col("__keys"))) == 0))
    tagged = tagged.withColumn("__notice", notice)
    names = lambda col: F.transform(col, lambda x: F.get(labels, x["t"]))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    at = F.transform("__base", lambda x: x["at"])
    licence = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.size("__base").cast("long").alias("places"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        joined(names("__base")).alias("base_labels"),
        joined(F.concat(names("__base"), names("__notice"))).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("__base", "__notice"), lambda x: x["weight"])), F.lit(0.0)).alias("score"),
    )
    return tagged.select("doc.*", licence.alias(free_name(docs, out_col)))

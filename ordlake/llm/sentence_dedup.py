"""Operator 7: substring deduplication by sliding spans of sentences.

Every run of SPAN consecutive sentences is hashed. A sentence of over LONG words counts as several: it is cut after
every word whose hash none of its neighbours falls below, so copies are cut alike wherever they begin. Runs are joined globally by hash; the
first place of a run (least doc_id, then place) stays, and every sentence covered by a later place of a repeated run
is removed. Runs are counted first, by their hashes alone; only places of repeated ones are joined. Counting is
reduced in each task; the few runs that hold a large share of all places are joined by
broadcast (a bounded number), so a line in a third of all documents is no hot key.

Runs are equal when 96 bits of their hash are: among 10^12 runs a false match is expected with probability 10^-5.

Defined results: a null or empty text has no sentences and is unchanged (null becomes empty); repeated rows and
equal texts keep their first row whole; words are compared after lowering A-Z, signs and spaces are not; a sentence
reaches from its first word to the next sentence's first word, so signs without words belong to the sentence before
and what stands before the first word is kept; texts of under SPAN sentences lose nothing; an empty table gives an
empty result; columns beside id and text are not returned. The rows are numbered and written first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .bloom import possibly_in, seen_filter
from .common import key_join, numbered, save

SPAN = 5
#: A sentence of more words is cut, after the words whose hash is the least of as many before and after them.
LONG, NEAR = 16, 3
#: Bytes of text that are read at a time.
PART = 1 << 20

_STOP = np.isin(np.arange(256), list(b".!?"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(start, hash, sentence break before) of the words of one block, and whether a break follows the last word."""
    b, start, _, h = bytehash.words(data)
    after = np.append(_SPACE[b[1:]], False)
    breaks = np.concatenate([[0], np.cumsum((b == 10) | (_STOP[b] & after))])
    seen = breaks[start]
    return start, h, np.diff(seen, prepend=0) > 0, bool(len(seen) and breaks[-1] > seen[-1])


def _pieces(text: bytes) -> Iterator[bytes]:
    """text cut before words into parts of about PART bytes."""
    at = 0
    while len(text) - at > PART:
        cut = at + PART
        while cut < len(text) and not (bytehash.is_word(text[cut]) and not bytehash.is_word(text[cut - 1])):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, hash, second hash) of the sentences of texts, in order."""
    owner, starts, hashes, firsts = [], [], [], []
    for own in bytehash.blocks(texts, PART):
        if len(own) > 1:
            data = b"\n".join([texts[i] for i in own])
            ends = np.cumsum([len(texts[i]) + 1 for i in own])
            start, h, new, _ = _words(data)
            k = np.searchsorted(ends, start, side="right")
            owner.append(np.array(own)[k])
            starts.append(start - np.concatenate([[0], ends[:-1]])[k])
            hashes.append(h)
            firsts.append(new)
            continue
        at, broken = 0, True
        for piece in _pieces(texts[own[0]]):
            start, h, new, after = _words(piece)
            if len(start):
                new[0] |= broken
                broken = after
            owner.append(np.full(len(start), own[0]))
            starts.append(start + at)
            hashes.append(h)
            firsts.append(new)
            at += len(piece)
    if not owner:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2)
    text, start, h, new = (np.concatenate(x) for x in (owner, starts, hashes, firsts))
    if not len(text):
        return text.astype(np.int64), start.astype(np.int64), h, h
    new[0] = True
    new[1:] |= text[1:] != text[:-1]
    number = np.cumsum(new) - 1
    size = np.bincount(number)
    by = bytehash.mix(h ^ np.uint64(0xA0761D6478BD642F))
    cut = size[number] > LONG
    for k in range(1, NEAR + 1):  # a word cuts if no hash near it in the sentence is less
        apart = number[k:] != number[:-k]
        cut[k:] &= apart | (by[k:] <= by[:-k])
        cut[:-k] &= apart | (by[:-k] <= by[k:])
    new[1:] |= cut[:-1]
    first = np.flatnonzero(new)
    inside = (np.arange(len(h)) - first[np.cumsum(new) - 1]).astype(np.uint64) * bytehash.BASE
    one, two = (np.add.reduceat(bytehash.mix(h * np.uint64(k) + inside), first) for k in (1, 0xD6E8FEB86659FD93))
    return text[first], start[first], one, two


_RUN = pa.struct([("hash", pa.int64()), ("more", pa.int32()), ("at", pa.int32())])


def runs(texts: list[bytes]) -> pa.ListArray:
    """The runs of every text: 96 bits of hash, and the number of the first sentence."""
    text, _, one, two = sentences(texts)
    n = max(len(text) - SPAN + 1, 0)
    totals = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    for j in range(SPAN):
        totals = [bytehash.mix(t * np.uint64(0x9FB21C651E98DF25) + v[j : n + j]) for t, v in zip(totals, (one, two), strict=True)]
    whole = text[:n] == text[SPAN - 1 :][:n]
    at = np.arange(len(text)) - np.searchsorted(text, text)
    fields = [totals[0][whole].view(np.int64), (totals[1][whole] >> np.uint64(32)).astype(np.uint32).view(np.int32), at[:n][whole].astype(np.int32)]
    ends = np.concatenate([[0], np.cumsum(np.bincount(text[:n][whole], minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in fields], fields=list(_RUN)))


def _runs(text: pa.Array) -> pa.Array:
    return bytehash.by_bytes(text, lambda some: runs(some.cast(pa.large_binary()).to_pylist()), pa.list_(_RUN), PART)


def cut(text: bytes, at: list[int]) -> tuple[bytes, int, int]:
    """(text without the sentences of the runs that start at the given ones, sentences removed, spans removed)."""
    _, first, _, _ = sentences([text])
    gone = np.zeros(len(first), bool)
    for j in range(SPAN):
        gone[np.array(at, dtype=np.int64) + j] = True
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    kept, last = [], 0
    bounds = np.append(first, len(text))
    for a, b in zip(bounds[np.flatnonzero(edge == 1)].tolist(), bounds[np.flatnonzero(edge == -1)].tolist(), strict=True):
        kept.append(text[last:a])
        last = b
    return b"".join([*kept, text[last:]]), int(gone.sum()), int((edge == 1).sum())


_CUT = pa.struct([("text", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


def _cut(text: pa.Array, at: pa.Array) -> pa.Array:
    parts = []
    for i, j in bytehash.slices(bytehash.sizes(text), PART, 1 << 12):
        rows = zip(text.slice(i, j - i).cast(pa.large_binary()).to_pylist(), at.slice(i, j - i).to_pylist(), strict=True)
        done = [cut(t, a) if a else (t, 0, 0) for t, a in rows]
        parts.append(pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.binary()).cast(pa.string()), *[pa.array([d[k] for d in done], pa.int64()) for k in (1, 2)]], fields=list(_CUT)))
    bytehash.give_back()
    return pa.concat_arrays(parts) if parts else pa.array([], _CUT)


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without repeated spans, n_removed (sentences), n_spans for every row."""
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "row")
    made = rows.select("doc_id", "row", F.explode(F.arrow_udf(_runs, "array<struct<hash:bigint,more:int,at:int>>")("text")).alias("r"))
    places = save(made.select(F.struct("r.hash", "r.more").alias("run"), "doc_id", "row", "r.at"), "places")
    repeated = save(places.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    # places of other runs needn't be shuffled again; the filter lets few of them through
    known = possibly_in(docs.sparkSession, seen_filter(repeated.select("run.hash"), repeated.count(), 1))
    again = save(places.filter(known("run.hash")), "again")
    place = F.struct("doc_id", "row", "at")
    first = save(again.groupBy("run").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), "first")
    later = key_join(again, first, "run", "n", again.count()).filter(place != F.col("first"))
    marks = later.groupBy("row").agg(F.collect_set("at").alias("at"))
    cleaned = rows.join(marks, "row", "left").select("doc_id", F.arrow_udf(_cut, "struct<text:string,n_removed:bigint,n_spans:bigint>")("text", "at").alias("c"))
    return cleaned.select("doc_id", "c.*")

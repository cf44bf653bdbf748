"""Operator 10: byte-level BPE encoding and decoding by merge replay over gathered words.

Each task gathers the distinct words (matches of the split pattern) of many documents and replays the merges over
all of them together: an inverted index leads from the rank of a token pair to the places where that pair stands;
ranks are taken in order, a merge is applied at all its places at once, and only the pairs beside a merged place are
indexed anew. Documents are put together from their words' tokens. Nothing is shuffled, so hot keys and groups of
copies have no effect.

Memory is bounded by bytes, not by rows: texts are split PART bytes at a time, new words are replayed as soon
as PIECE words wait, the tokens of words are kept from batch to batch and forgotten once these hold WORD_CHARS characters, ids
go where they stay, and are spelled PIECE at a time. Only a text that is itself longer than that, with its ids, is held whole.

Defined results: a null text is the empty one and has no tokens; decoding gives back the text's UTF-8 bytes; null
ids decode to no bytes; equal texts and repeated rows are coded alike, row by row; an empty table gives an empty
result; rows, order and other columns are untouched; where the input has a column of the result's name already, the
result's name gets underscores until it is free.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import new_column

#: Bytes of text split at a time, characters of distinct words replayed together, and words or ids put together at a time.
PART, WORD_CHARS, PIECE = 1 << 20, 1 << 20, 1 << 18
DIGESTS = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


class Vocabulary:
    """Ranks of a tiktoken file, and the token that every pair of tokens makes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        n = max(ids.values()) + 1
        tokens = [b""] * n
        for token, i in ids.items():
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.decimal = pa.array([b"%d " % i for i in range(n)], pa.large_binary())
        self.single = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, i in ids.items():
            for k in range(1, len(token)):
                a, b = ids.get(token[:k]), ids.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[x] for x in self.pairs.tolist()], dtype=np.int32)
        self.gathered = _Gathered(self)  # words are known from one batch to the next

    @classmethod
    @cache
    def at(cls, path: str) -> Vocabulary:
        return cls(path)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, which is its rank; -1 for none."""
        code = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where((self.pairs[at] == code) & (a >= 0) & (b >= 0), self.made[at], np.int32(-1))


def _by_rank(ranks: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    own = ranks >= 0
    ranks, places = ranks[own], places[own]
    if len(ranks):
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        yield from zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True)


def replay(data: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all words in order, end of each word's tokens) for words given as bytes and their ends."""
    n = len(data)
    token = np.append(v.single[data], np.int32(-1))  # place n stands for no neighbour
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[n] = n
    starts = np.concatenate([[0], ends[:-1]])[ends > np.concatenate([[0], ends[:-1]])]
    before[starts], after[ends[ends > 0] - 1] = n, n
    rank = np.append(v.ranks(token[:n], token[after[:n]]), np.int32(-1))
    index = {r: [places] for r, places in _by_rank(rank[:n], np.arange(n, dtype=np.int32))}
    queue = list(index)
    heapify(queue)
    taken = np.zeros(n + 1, dtype=bool)
    while queue:
        m = heappop(queue)
        found = index.pop(m)
        left = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        left = left[rank[left] == m]
        if not len(left):
            continue
        taken[left] = True
        if taken[after[left]].any():  # a run such as aaa: from the left, each place is in one merge at most
            for i in left.tolist():
                if taken[i]:
                    taken[after[i]] = False
            left = left[taken[left]]
        taken[left] = False
        right = after[left]
        token[left], token[right], rank[right] = m, -1, -1
        after[left] = after[right]
        before[after[left]] = left
        before[n] = n
        beside = np.concatenate([left, before[left]])
        beside = beside[beside < n]
        rank[beside] = v.ranks(token[beside], token[after[beside]])
        for r, places in _by_rank(rank[beside], beside):
            if r in index:
                index[r].append(places)
            else:
                index[r] = [places]
                heappush(queue, r)
    alive = token[:n] >= 0
    return token[:n][alive], np.concatenate([[0], np.cumsum(alive)])[ends].astype(np.int64)


class _Gathered:
    """Distinct words with their tokens, and the places where words stand that are not put together yet."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.begin()
        self.forget()

    def begin(self) -> None:
        self.places, self.n = [], 0

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.tokens, self.ends = 0, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, words: list[str]) -> None:
        known, had = self.known, len(self.known)
        for w in dict.fromkeys(words):
            if w not in known:
                known[w] = len(known)
        self.chars += sum(map(len, islice(reversed(known), len(known) - had)))
        self.places.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.n += len(words)

    def full(self) -> bool:
        return self.chars >= WORD_CHARS or self.n >= PIECE

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all places in order, number of tokens of each); the words' tokens stay until they are many."""
        had = len(self.ends) - 1
        new = [w.encode("utf-8", "replace") for w in islice(self.known, had, None)]
        tokens, ends = replay(np.frombuffer(b"".join(new), np.uint8), np.cumsum([len(w) for w in new], dtype=np.int64), self.v)
        self.tokens, self.ends = np.concatenate([self.tokens, tokens]), np.concatenate([self.ends, self.ends[-1] + ends])
        own = np.concatenate(self.places)
        n = np.diff(self.ends)[own]
        at = np.repeat((self.ends[own] - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
        out = self.tokens[at]
        self.begin()
        if self.chars >= WORD_CHARS:
            self.forget()
        return out, n


def encode_texts(text: pa.Array, v: Vocabulary, pattern: regex.Pattern) -> pa.ListArray:
    """Token ids of every text."""
    got = v.gathered
    got.begin()  # places are left where a batch has failed
    size = bytehash.sizes(text)
    ids, n_ids = np.empty(int(size.sum()), np.int32), 0  # a token has a byte at least; memory that is not written is not taken
    total = np.zeros(len(text) + 1, np.int64)  # tokens of text i at i + 1
    owner: list[np.ndarray] = []

    def flush() -> None:
        nonlocal owner, n_ids
        if got.n:
            tokens, n = got.take()
            ids[n_ids : n_ids + len(tokens)] = tokens
            n_ids += len(tokens)
            total[:-1] += np.bincount(np.concatenate(owner), n, len(text)).astype(np.int64)
            owner = []

    for i, j in bytehash.slices(size, PART, PART):
        for k, t in enumerate(text.slice(i, j - i).to_pylist(), i):
            found = pattern.finditer(t or "")
            while words := [m.group() for m in islice(found, PIECE)] if len(t or "") > PART else pattern.findall(t or ""):
                got.add(words)
                owner.append(np.full(len(words), k, np.int32))
                if got.full():
                    flush()
                if len(t) <= PART:
                    break
    flush()
    ends = np.concatenate([[0], np.cumsum(total[:-1])])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[:n_ids]))


def _spelled(ids: pa.ListArray, words: pa.LargeBinaryArray) -> Iterator[memoryview]:
    """The joined bytes of every row's ids by a table of words; a bounded number of ids is spelled at a time."""
    size = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for i, j in bytehash.slices(size, PIECE, PIECE):
        data, offsets = bytehash.buffers(words.take(ids.slice(i, j - i).flatten()))
        bounds = offsets[np.concatenate([[0], np.cumsum(size[i:j])])].tolist()
        raw = memoryview(data)
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield raw[a:b]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with an array of token ids; vocabulary is the path of a rank file on every machine."""

    def run(text: pa.Array) -> pa.Array:
        out = encode_texts(text, Vocabulary.at(vocabulary), regex.compile(pattern))
        bytehash.give_back()
        return out

    return new_column(docs, out_col, F.arrow_udf(run, "array<int>")(F.col(text_col)))


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """docs with the bytes that the token ids stand for."""

    def run(ids: pa.Array) -> pa.Array:
        out = pa.array([x.tobytes() for x in _spelled(ids, Vocabulary.at(vocabulary).tokens)], pa.binary())
        bytehash.give_back()
        return out

    return new_column(docs, out_col, F.arrow_udf(run, "binary")(F.col(ids_col)))


def digests(ids: Column, vocabulary: str) -> Column:
    """DIGESTS of token ids: their number, SHA-256 of the decimal ids joined by one space, and of the decoded bytes."""

    def run(ids: pa.Array) -> pa.Array:
        v = Vocabulary.at(vocabulary)
        size = ids.value_lengths().fill_null(0).cast(pa.int64())
        spelled = [pa.array([hashlib.sha256(x[:-1] if cut else x).hexdigest() for x in _spelled(ids, words)], pa.string()) for words, cut in ((v.decimal, True), (v.tokens, False))]
        bytehash.give_back()
        return pa.StructArray.from_arrays([size, *spelled], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.arrow_udf(run, DIGESTS)(ids)

"""Operator 11: best-fit packing of token sequences, certified by lower bounds.

Documents become token ids; only those longer than a sequence are cut. A full piece is a sequence of its own. All
others are dealt by hash to shards of about SHARD pieces, and each shard is packed by best-fit decreasing. Dual feasible functions of
the lengths (Fekete and Schepers: u(k), U(e), phi(e), with L1 as k -> infinity) give a number of bins that no packing can go below:
a shard that meets its bound is certified and stays. Shards with a gap release every bin that is not full, and, as long
as the total is above the bound of all lengths together, certified shards their emptiest bin; released documents are dealt
anew, so they meet those of other shards, and are packed again. A round that saves no bin is not taken and ends the work.
What crosses the cluster is a few numbers for each piece, never token ids; the bound of the whole comes from a table of lengths
(at most as many rows as a sequence has tokens).

Text is encoded by the tokenizers library itself, once for each distinct run of non-space characters that a task
holds: no pre-token of this vocabulary's pattern spans white space, so the ids of a text are those of its runs, one after the other.

Defined results: a null text counts as empty and is the end id alone; repeated rows are documents of their own; ties (equal
lengths, equally full bins) are broken arbitrarily, so sequence numbers may differ from run to run; very long texts are
encoded piece by piece; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Tokens of a sequence; the id that ends a document; pieces of a shard, about; exchanges at most.
LENGTH, END, SHARD, ROUNDS = 2048, 0, 1 << 14, 6
#: Distinct runs that a worker holds, longest run that is held, characters that are looked up at a time.
HELD, LONG, PART = 300_000, 64, 1 << 22

#: White space of the tokenizer's pattern; Arrow's split also takes the separators 1C to 1F, which are no white space there.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATOR = "[\x1c-\x1f]"
#: Runs of these characters only (printable ASCII, Latin letters in their composed form) are lower-cased letter by letter and cut by _PRE
#: exactly as the vocabulary's own normalizer and pattern do; any other run goes through those.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ĮĲ-ňŊ-ž]+").fullmatch
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-zß-öø-ž0-9\n]+").sub
#: Stand for the end of a word and of a run; neither is in a plain run.
_EOW, _EOR = "\x01", "\n"
_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_tokenizers: dict = {}


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: its own if printable, else the next from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: b if b in own else 256 + others.index(b) for b in range(256)}


def _merger(vocabulary: str):
    """A tiktoken encoding of plain words, each followed by _EOW, and the ids of the vocabulary for its ranks.

    The vocabulary's first symbols are bytes, the last of a word with its end; so a byte and _EOW merge before all else,
    and then the vocabulary's merges follow in their order.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of = {chr(c): bytes([b]) for b, c in _byte_characters().items()}
    end = model["end_of_word_suffix"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    raw = lambda t: b"".join(map(byte_of.__getitem__, t.removesuffix(end))) + (_EOW.encode() if t.endswith(end) else b"")
    names = [c + end for c in byte_of] + [a + b for a, b in pairs] + list(byte_of)
    ranks = {raw(t): i for i, t in enumerate(names)}
    merger = tiktoken.Encoding("words", pat_str=f"[^{_EOW}{_EOR}]+{_EOW}|{_EOR}", mergeable_ranks=ranks, special_tokens={})
    return merger, np.array([model["vocab"][t] for t in names], "<u4"), ranks[_EOR.encode()]


class Encoder:
    """Token ids, as little-endian unsigned 32-bit numbers, of texts; one a worker process and vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merger, self.id_of, self.stop = _merger(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def at(path: str) -> Encoder:
        if path not in _tokenizers:
            _tokenizers[path] = Encoder(path)
        return _tokenizers[path]

    def _encode_runs(self, runs: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        plain: list[str] = []
        for w in runs:
            if _PLAIN(w) and not ("<" in w and self.special(w)):
                plain.append(w)
            else:
                yield w, array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        if plain:
            ranks = self.merger.encode_to_numpy(_WORD(rf"\g<0>{_EOW}", _EOR.join([*plain, ""]).lower()), disallowed_special=())
            stops = np.flatnonzero(ranks == self.stop)
            ids = self.id_of[ranks].tobytes()
            yield from zip(plain, (ids[4 * i : 4 * j] for i, j in zip([0, *(stops[:-1] + 1).tolist()], stops.tolist(), strict=True)), strict=True)

    def encode(self, parts: list[str]) -> list[bytes]:
        """The ids of every part; parts begin and end at white space."""
        texts = pa.array(parts, pa.string())
        if pc.any(pc.match_substring_regex(texts, _SEPARATOR)).as_py():
            lists = pa.array([_SPACE.split(p) for p in parts], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        coded = lists.values.dictionary_encode()
        here = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > HELD:  # what was not asked for since the last time goes
            self.known, self.older = {}, self.known
        new = [w for w in here if w not in self.known]
        found = {w: self.older[w] for w in new if w in self.older}
        found |= self._encode_runs([w for w in new if w not in found])
        self.known |= {w: ids for w, ids in found.items() if len(w) <= LONG}
        known = [self.known[w] if len(w) <= LONG else found[w] for w in here]
        ids, size = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        run = coded.indices.to_numpy()
        n = size[run]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat((np.cumsum(size) - size)[run] - ends[:-1], n) + np.arange(ends[-1])]
        of_part = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [out[i:j].tobytes() for i, j in zip(of_part, of_part[1:], strict=False)]


def parts_of(text: str) -> Iterator[str]:
    """Parts of about PART characters that end at white space."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PART:
            found = _SPACE.search(text, at + PART)
            end = found.end() if found else end
        yield text[at:end]
        at = end


def _pieces(path: str, length: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(doc_id, text: str, encode: Encoder, first: bytes | None) -> Iterator[tuple]:
        held, start, piece, end = b"", 0, 0, array("I", [END]).tobytes()
        for ids in [first + end] if first is not None else _last(encode.encode([p])[0] for p in parts_of(text)):
            held += ids if ids is not None else end
            full = len(held) // 4 > length
            at = 0
            while full and len(held) - at > 4 * length:
                part = held[at : at + 4 * length]
                yield doc_id, piece, start, length, crc32(part), part
                at, piece, start = at + 4 * length, piece + 1, start + length
            held = held[at:]
        yield doc_id, piece, start, len(held) // 4, crc32(held), held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.at(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                group, size, begin = [], 0, at
                while at < len(ids) and (not group or size < PART):
                    group.append(texts[at].as_py() or "")
                    size += len(group[-1])
                    at += 1
                firsts = [None] if size > 2 * PART and len(group) == 1 else encode.encode(group)
                rows = [r for d, t, f in zip(ids[begin:at], group, firsts, strict=True) for r in cut(d, t, encode, f)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array([r[i] for r in rows], types[i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _last(ids: Iterator[bytes]) -> Iterator[bytes | None]:
    yield from ids
    yield None  # the end


def token_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]), written: the documents' token ids, cut after length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, length, with_ids), schema)
    return save(pieces.select(F.monotonically_increasing_id().alias("uid"), "*"), "pieces")


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size by best-fit decreasing; equal sizes go in runs."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: dict[int, list[int]] = {}  # bins by what is left in them
    left, n_bins, i = 0, 0, 0  # left: bit r is set where free[r] has bins
    while i < len(order):
        size = int(sizes[order[i]])
        end = i + int(np.searchsorted(-sizes[order[i:]], -size, "right"))
        while i < end:
            fits = left >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = free[room].pop()
                if not free[room]:
                    left ^= 1 << room
            else:
                room, b = length, n_bins
                n_bins += 1
            n = min(room // size, end - i)
            at = order[i : i + n]
            bins[at] = b
            offsets[at] = length - room + size * np.arange(n)
            room -= n * size
            i += n
            if room:
                if not free.setdefault(room, []):
                    left |= 1 << room
                free[room].append(b)
    return bins, offsets


def lower_bound(counts: np.ndarray, length: int) -> int:
    """Bins that any packing of counts[s] pieces of size s needs; counts has length + 1 places."""
    s = np.arange(length + 1, dtype=np.int64)
    counts = counts.astype(object) if counts.sum() > 1 << 40 else counts.astype(np.int64)  # exact at any size
    up = lambda total, whole: -(-int(total) // whole)
    best = up((counts * s).sum(), length)
    for k in range(1, 101):  # u(k): x where (k + 1) x is whole, else floor((k + 1) x) / k
        worth = np.where(s * (k + 1) % length == 0, s * k, s * (k + 1) // length * length)
        best = max(best, up((counts * worth).sum(), k * length))
    many, mass = np.cumsum(counts), np.cumsum(counts * s)
    for e in range(1, length // 2 + 1):
        over = many[length] - many[length - e]  # U(e): 1 above 1 - e, x between, 0 below e
        best = max(best, up(over * length + mass[length - e] - mass[e - 1], length))
        m = length // e  # phi(e): halves keep their place by what fits beside them
        half = length // 2
        big = m * (many[length] - many[half]) - (counts[half + 1 :] * ((length - s[half + 1 :]) // e)).sum()
        best = max(best, up(big + many[half] - many[e - 1], m))
    return best


def _packed(items: DataFrame, turn: int, shards: int, length: int) -> DataFrame:
    """items with bin, offset, fill, whether the shard meets its bound, and whether the bin is its emptiest; written."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["length"].to_numpy()
        bins, offsets = best_fit(sizes, length)
        fill = np.bincount(bins, sizes).astype(np.int64)
        certified = len(fill) == lower_bound(np.bincount(sizes, minlength=length + 1), length)
        shard = int(group["shard"].iloc[0])
        return group.drop(columns="shard").assign(sequence_id=(turn << 58) | (shard << 22) | bins, offset=offsets, fill=fill[bins], certified=certified, emptiest=bins == fill.argmin())

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(shards)))
    out = dealt.groupBy("shard").applyInPandas(pack, f"{_PIECES}, sequence_id long, offset long, fill long, certified boolean, emptiest boolean")
    return save(out, f"packed{turn}")


def _n_bins(placed: DataFrame) -> int:
    return placed.filter("offset = 0").count()


def pack(pieces: DataFrame, length: int = LENGTH) -> tuple[DataFrame, dict[str, int]]:
    """pieces with sequence_id and offset, and the numbers of sequences, of their lower bound and of exchanges taken."""
    full = pieces.filter(F.col("length") == length)
    items = pieces.filter(F.col("length") < length).drop("ids")
    own = [c for c in items.columns]
    by_length = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most length rows
    bound = lower_bound(np.array([by_length.get(i, 0) for i in range(length + 1)], object if sum(by_length.values()) > 1 << 40 else np.int64), length)
    n = sum(by_length.values())
    placed = _packed(items, 0, max(1, -(-n // SHARD)), length)
    total, taken, kept = _n_bins(placed), 0, []
    for turn in range(1, ROUNDS + 1):
        if total <= bound:
            break
        goes = F.when(F.col("certified"), F.col("emptiest")).otherwise(F.col("fill") < length)
        out = placed.filter(goes)
        had, n = _n_bins(out), out.count()
        again = _packed(out.select(*own), turn, max(1, -(-n // SHARD)), length)
        saved = had - _n_bins(again)
        if saved <= 0:
            break
        kept.append(placed.filter(~goes))
        placed, total, taken = again, total - saved, turn
    result = full.drop("ids").withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    for part in [*kept, placed]:
        result = result.unionByName(part.select(*own, "sequence_id", "offset"))
    n_full = full.count()
    return result, {"sequences": total + n_full, "bound": bound + n_full, "exchanges": taken}


def sequences(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids): the packed sequences with their token ids."""
    pieces = token_pieces(docs, vocabulary, length, with_ids=True)
    placed, _ = pack(pieces, length)
    ids = placed.select("uid", "sequence_id", "offset").join(pieces.select("uid", "ids"), "uid")

    def numbers(joined: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in joined.to_pylist()], pa.list_(pa.int32()))

    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most length pieces
    whole = ids.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
    return whole.select("sequence_id", F.arrow_udf(numbers, "array<int>")("ids").alias("ids"))

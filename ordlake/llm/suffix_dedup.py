"""Operator 8: removal of repeated 200-byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Which suffixes are sorted. Two equal strings of LENGTH bytes hold the same least-hashed GRAM at the same place, so
it is enough to sort the suffixes that start at such anchors (about one in 70 bytes), each with the bytes before
it. Anchors whose gram stands nowhere else can't be in a repeated string and are left out first, as published
distributed string sorters do with fingerprints; equal suffixes are sent once, with a mark that there are several.

How they are sorted. Each task sorts its suffixes, front-codes the run (common prefix length and rest) and sends
it by range; a range is merged with a loser tree that keeps for every run the length of the prefix it shares with
the last winner, so known prefixes are never compared again. The merged order and its common prefix lengths, with
the order of the bytes before the anchors, tell for every string around an anchor whether it stands elsewhere.
Hashes take part before that: suffixes are sent once for all anchors whose 64-bit hash of the bytes around agrees.

Only grams, marks and distinct suffixes are exchanged; the places of a hot suffix stay in blocks by the task that
found them, so a third of all rows in one group makes no hot task.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; overlaps count, and strings are
judged on the input; equal texts and repeated rows lose all strings of LENGTH bytes, the first included; an empty
table gives an empty result. The rows are numbered and written first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import numbered, save, small_join

LENGTH, GRAM = 200, 64
#: Grams in a string, bytes kept before an anchor, and bytes of a sorted suffix with those before it in reverse.
WINDOW = LENGTH - GRAM + 1
BEFORE = WINDOW - 1
WIDE = LENGTH + BEFORE
#: Bytes of text in one numpy pass, of text for a shard of grams and a range, and suffixes of a run.
BLOCK, SHARD_BYTES, RUN = 1 << 20, 1 << 24, 1 << 16
#: Sent suffixes by which each range is cut, so the sample grows with the ranges.
SAMPLED = 8
#: Blocks of places that one task joins with the results of a shard.
PLACES = 64
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, size: int, ufunc: np.ufunc, fill: np.uint64) -> np.ndarray:
    """ufunc over x[i : i + size] for every i; past the end counts as fill."""
    n = -(-(len(x) + size) // size) * size
    padded = np.full(n, fill, dtype=np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, size)
    ahead = ufunc.accumulate(rows, axis=1).ravel()
    back = ufunc.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[: len(x)], ahead[size - 1 : size - 1 + len(x)])


def _anchors(b: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, hash of the bytes around) of the anchors of windows that start in [low, high) of each piece."""
    n = len(b)
    up, down = bytehash.powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    piece = np.repeat(np.arange(len(begin)), end - begin)
    at = np.arange(n)
    stop = end[piece]
    gram = np.full(n, _MAX, dtype=np.uint64)
    ok = np.flatnonzero(at + GRAM <= stop)
    gram[ok] = bytehash.mix((total[ok + GRAM] - total[ok]) * down[ok])
    least = _slide(gram, WINDOW, np.minimum, _MAX)
    least[(at + LENGTH > stop) | (at < low[piece]) | (at >= high[piece])] = 0
    most = _slide(least[::-1], WINDOW, np.maximum, np.uint64(0))[::-1]
    place = np.flatnonzero((most == gram) & (at + GRAM <= stop))
    first, last = np.maximum(place - BEFORE, begin[piece[place]]), np.minimum(place + LENGTH, stop[place])
    around = (total[last] - total[first]) * down[first]
    around = bytehash.mix(around + ((place - first) * 1000 + last - place).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return place, gram[place], around


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, gram hash, hash around) of the anchors of blocks of texts; long texts are cut with overlap."""
    margin = LENGTH + WIDE
    items = [(i, lo, min(lo + BLOCK, len(t))) for i, t in enumerate(texts) if len(t) >= LENGTH for lo in range(0, len(t), BLOCK)]
    group: list[tuple[int, int, int]] = []
    size = 0
    for item in [*items, None]:
        if group and (item is None or size + item[2] - item[1] > BLOCK):
            parts = [texts[i][max(0, lo - margin) : hi + margin] for i, lo, hi in group]
            skip = np.array([max(0, lo - margin) for _, lo, _ in group])
            end = np.cumsum([len(p) for p in parts])
            begin = end - [len(p) for p in parts]
            low = begin + [lo for _, lo, _ in group] - skip
            high = begin + [hi for _, _, hi in group] - skip
            place, gram, around = _anchors(np.frombuffer(b"".join(parts), np.uint8), begin, end, low, high)
            k = np.searchsorted(end, place, side="right")
            yield np.array([g[0] for g in group])[k], place - begin[k] + skip[k], gram, around
            group, size = [], 0
        if item is not None:
            group.append(item)
            size += item[2] - item[1]


def _bytes(text: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in text]


def _by_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut where their rows' numbers leave a range of 2 ** 32: a batch may hold rows of several small files, and
    places are kept as differences of 32 bits to the least number."""
    for batch in batches:
        yield from (batch.iloc[s:e] for s, e in _cuts(batch["row"].to_numpy() >> 32))


def _find(n_shards: int):
    """Blocks (chunk, shard) of anchors: distinct (gram, around), their marks of several, and places by number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, batch in enumerate(_by_files(batches)):
            chunk = TaskContext.get().partitionId() << 32 | number
            rows = batch["row"].to_numpy()
            found = list(anchors(_bytes(batch["text"])))
            if not found:
                continue
            text, place, gram, around = (np.concatenate(x) for x in zip(*found, strict=True))
            shard = (gram >> np.uint64(32)).astype(np.int64) % n_shards
            order = np.lexsort((place, text, around, gram, shard))
            text, place, gram, around, shard = text[order], place[order], gram[order], around[order], shard[order]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1])])  # pieces overlap
            text, place, gram, around, shard = text[new], place[new], gram[new], around[new], shard[new]
            base = rows.min()
            for s, e in _cuts(shard):
                first = np.flatnonzero(np.concatenate([[True], (gram[s + 1 : e] != gram[s : e - 1]) | (around[s + 1 : e] != around[s : e - 1])]))
                count = np.diff(first, append=e - s).astype(np.uint32)
                yield pd.DataFrame({"chunk": [chunk], "shard": [int(shard[s])], "base": [int(base)], "gram": [gram[s:e][first].tobytes()], "around": [around[s:e][first].tobytes()], "several": [np.packbits(count > 1).tobytes()], "counts": [count.tobytes()], "places": [np.stack([rows[text[s:e]] - base, place[s:e]], axis=1).astype(np.uint32).tobytes()]})

    return run


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values of a sorted array."""
    at = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]).tolist()
    return [(a, b) for a, b in zip(at, at[1:], strict=False) if b > a]


#: Class of an anchor within its shard; bits above tell that this block sends its suffix, and that there are several.
SENDS, SEVERAL = 1 << 30, 1 << 29


def _classes(group: pd.DataFrame) -> pd.DataFrame:
    """For every block of one shard the classes of its anchors; -1 where the gram stands nowhere else."""
    group = group.sort_values("chunk")
    gram = [np.frombuffer(x, np.uint64) for x in group["gram"]]
    sizes = [len(x) for x in gram]
    gram = np.concatenate(gram)
    around = np.concatenate([np.frombuffer(x, np.uint64) for x in group["around"]])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group["several"], sizes, strict=True)])
    order = np.lexsort((around, gram))
    g, a, m = gram[order], around[order], several[order]
    lead = np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1])])
    head = np.concatenate([[True], g[1:] != g[:-1]])
    number = np.cumsum(lead) - 1
    many = (np.bincount(number) + np.bincount(number, m)) > 1
    gram_number = np.cumsum(head) - 1
    again = ((np.bincount(gram_number) + np.bincount(gram_number, m)) > 1)[gram_number]
    kept = np.cumsum(lead & again) - 1
    out = np.full(len(g), -1, dtype=np.int32)
    out[order] = np.where(again, kept | lead * SENDS | many[number] * SEVERAL, -1)
    return pd.DataFrame({"shard": group["shard"].to_numpy(), "chunk": group["chunk"].to_numpy(), "class": [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]})


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks with the places of repeated grams only, and the one suffix of each class that is sent."""
    for batch in batches:
        out = []
        for chunk, shard, base, counts, places, cls in zip(batch["chunk"], batch["shard"], batch["base"], batch["counts"], batch["places"], batch["class"], strict=True):
            cls, counts = np.frombuffer(cls, np.int32), np.frombuffer(counts, np.uint32)
            places = np.frombuffer(places, np.uint32).reshape(-1, 2)
            own = cls >= 0
            if not own.any():
                continue
            first = (np.cumsum(counts) - counts)[own & (cls & SENDS > 0)]
            sent = cls[own & (cls & SENDS > 0)]
            each = np.repeat(own, counts)
            sends = [{"row": int(base) + int(r), "at": int(p), "class": int(c)} for (r, p), c in zip(places[first], sent & ~SENDS, strict=True)]
            out.append((chunk, shard, base, np.repeat(cls[own] & ~(SENDS | SEVERAL), counts[own]).astype(np.int32).tobytes(), places[each].tobytes(), sends))
        yield pd.DataFrame(out, columns=["chunk", "shard", "base", "class", "places", "sends"])


def front_code(rows: np.ndarray) -> bytes:
    """Sorted rows of equal width: common prefix with the row before, then the rest of each."""
    common = common_prefix(rows)
    return zlib.compress(common.astype(np.uint16).tobytes() + rows[np.arange(rows.shape[1]) >= common[:, None]].tobytes(), 1)


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before; 0 for the first."""
    out = np.zeros(len(rows), dtype=np.int64)
    for i in range(1, len(rows), 1 << 14):
        differs = rows[i : i + (1 << 14)] != rows[i - 1 : i - 1 + len(rows[i : i + (1 << 14)])]
        out[i : i + (1 << 14)] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def decode(coded: bytes, n: int, width: int = WIDE) -> Iterator[tuple[bytes, int]]:
    """(row, common prefix with the row before) of a front-coded run."""
    raw = zlib.decompress(coded)
    common = np.frombuffer(raw[: 2 * n], np.uint16).tolist()
    at, row = 2 * n, b""
    for c in common:
        row = row[:c] + raw[at : at + width - c]
        at += width - c
        yield row, c


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, row, common prefix with the row before) in order, by a loser tree.

    shared[r] is the prefix that the head of run r has in common with the last winner. Of two heads the one that
    shares more is the smaller; only where they share alike are bytes compared, from there on.
    """
    k = len(runs)
    head: list[bytes | None] = [None] * k
    shared = [0] * k
    for r in range(k):
        head[r], _ = next(runs[r], (None, 0))

    def beats(a: int, b: int) -> bool:
        """True if run a's head comes first; the loser's shared prefix then counts against the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return y is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        s = shared[a]
        different = int.from_bytes(x[s:], "big") ^ int.from_bytes(y[s:], "big")
        if not different:
            shared[b if a < b else a] = len(x)
            return a < b
        s = len(x) - (different.bit_length() + 7) // 8
        first = x[s] < y[s]
        shared[b if first else a] = s
        return first

    losers = [-1] * k
    winner = -1
    for r in range(k):  # play the leaves in
        current, node = r, (r + k) // 2
        while node > 0:
            if losers[node] < 0:
                losers[node] = current
                current = -1
                break
            if beats(losers[node], current):
                losers[node], current = current, losers[node]
            node //= 2
        if current >= 0:
            winner = current
    while winner >= 0 and head[winner] is not None:
        yield winner, head[winner], shared[winner]
        head[winner], shared[winner] = next(runs[winner], (None, 0))
        node = (winner + k) // 2
        while node > 0:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def _sort(splitters: np.ndarray):
    """Sorted, front-coded runs of suffixes, cut by range; documents come with the suffixes they send."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0
        rows: list[np.ndarray] = []
        tags: list[np.ndarray] = []

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal rows, tags, number
            if not rows:
                return
            m, t = np.concatenate(rows), np.concatenate(tags)
            order = np.argsort(np.ascontiguousarray(m).view(f"S{WIDE}").ravel(), kind="stable")
            m, t = m[order], t[order]
            part = np.searchsorted(splitters, np.ascontiguousarray(m[:, :GRAM]).view(f"S{GRAM}").ravel(), side="right")
            for s, e in _cuts(part):
                yield pd.DataFrame({"part": [int(part[s])], "run": [TaskContext.get().partitionId() << 32 | number], "n": [e - s], "coded": [front_code(m[s:e])], "tags": [t[s:e].tobytes()]})
            rows, tags, number = [], [], number + 1

        for batch in batches:
            for text, sends in zip(_bytes(batch["text"]), batch["sends"], strict=True):
                at = np.array([s["at"] for s in sends], dtype=np.int64)
                b = np.zeros(BEFORE + len(text) + LENGTH, np.uint8)
                b[BEFORE : BEFORE + len(text)] = np.frombuffer(text, np.uint8)
                wide = np.concatenate([np.arange(LENGTH), np.arange(-1, -BEFORE - 1, -1)])
                for i in range(0, len(at), 4096):
                    own = at[i : i + 4096]
                    rows.append(b[own[:, None] + BEFORE + wide])
                    tags.append(np.array([[s["shard"], s["class"], min(BEFORE, s["at"]), min(LENGTH, len(text) - s["at"])] for s in sends[i : i + 4096]], dtype=np.int32))
                    if sum(map(len, rows)) >= RUN:
                        yield from flush()
        yield from flush()

    return run


def _judge(group: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of one range; which strings around each suffix stand elsewhere, as a bit for each start."""
    group = group.sort_values("run")
    tags = [np.frombuffer(x, np.int32).reshape(-1, 4) for x in group["tags"]]
    merged = list(merge([decode(c, n) for c, n in zip(group["coded"], group["n"], strict=True)]))
    which = np.array([m[0] for m in merged])
    order = np.argsort(which, kind="stable")
    tag = np.empty((len(merged), 4), np.int32)
    tag[order] = np.concatenate(tags)
    common = np.array([m[2] for m in merged])
    flags = repeated_starts(b"".join([m[1] for m in merged]), common, tag[:, 2], tag[:, 3], tag[:, 1] & SEVERAL > 0)
    own = flags.any(axis=1)
    return pd.DataFrame({"shard": tag[own, 0].astype(np.int64), "class": (tag[own, 1] & ~SEVERAL).astype(np.int64), "starts": [x.tobytes() for x in np.packbits(flags[own], axis=1)]})


def repeated_starts(data: bytes, common: np.ndarray, before: np.ndarray, after: np.ndarray, several: np.ndarray) -> np.ndarray:
    """For sorted suffixes, whether the string that starts o bytes before each (column o) stands elsewhere.

    Strings agree if their bytes from the anchor on do, by the common prefixes of the sorted suffixes, and their
    bytes before it do, by those of the reversed bytes before.
    """
    n = len(common)
    offset = np.arange(WINDOW)
    valid = (offset <= before[:, None]) & (LENGTH - offset <= after[:, None])
    flags = valid & several[:, None]
    near = np.maximum(common, np.append(common[1:], 0)) >= GRAM
    own = np.flatnonzero(near)  # a suffix whose gram has no equal needs no comparison
    if not len(own):
        return flags
    # two chosen neighbours share at least what all between them share; those between belong to other grams
    right = np.minimum(np.minimum.reduceat(common[: own[-1] + 1], np.concatenate([[0], own[:-1] + 1])), LENGTH)
    rows = np.frombuffer(data, np.uint8).reshape(n, WIDE)
    left = np.ascontiguousarray(rows[own, LENGTH:])
    order = np.argsort(left.view(f"S{BEFORE}").ravel(), kind="stable")
    shared = common_prefix(left[order])
    for o in range(WINDOW):
        use = valid[own, o]
        if use.sum() < 2:
            continue
        after_class = np.cumsum(right < LENGTH - o)
        before_class = np.empty(len(own), np.int64)
        before_class[order] = np.cumsum(shared < o)
        key = (after_class * (len(own) + 1) + before_class)[use]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(key), bool)
        hit[by[1:]] |= same
        hit[by[:-1]] |= same
        flags[own[use][hit], o] = True
    return flags


def _spans(places: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """Covered (row, first, last) of the places of one shard's blocks."""
    out = []
    if len(places) and len(starts):
        known = np.full(int(starts["class"].max()) + 1, -1, np.int64)
        known[starts["class"]] = np.arange(len(starts))
        bits = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in starts["starts"]]), axis=1, count=WINDOW)
        # maximal runs of starts of each class: covered bytes from -last offset to LENGTH - first offset
        edge = np.diff(bits.astype(np.int8), axis=1, prepend=0, append=0)
        owner, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        first = np.searchsorted(owner, np.arange(len(bits) + 1))
        for base, cls, place in zip(places["base"], places["class"], places["places"], strict=True):
            cls, place = np.frombuffer(cls, np.int32), np.frombuffer(place, np.uint32).reshape(-1, 2).astype(np.int64)
            code = np.where(cls < len(known), known[np.minimum(cls, len(known) - 1)], -1)
            place, code = place[code >= 0], code[code >= 0]
            n = first[code + 1] - first[code]
            k = np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = np.repeat(place[:, 1], n)
            out.append(pd.DataFrame({"row": int(base) + np.repeat(place[:, 0], n), "first": at - high[k], "last": at - low[k] + LENGTH}))
    return pd.concat(out) if out else pd.DataFrame({"row": [], "first": [], "last": []}).astype(np.int64)


def cut(text: bytes, spans: list) -> tuple[int, int, int, str, bytes]:
    """(bytes, removed, removed runs, SHA-256 of the rest, the rest)."""
    spans = sorted((s["first"], s["last"]) for s in spans)
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for a, b in spans:
        if a > end:
            kept.append(text[at:a])
            runs += 1
            end = a
        if b > end:
            removed += b - end
            end = b
            at = b
    kept.append(text[at:])
    rest = b"".join(kept)
    return len(text), removed, runs, hashlib.sha256(rest).hexdigest(), rest


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) for every row."""
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "row")
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()
    n_shards = max(8, (total["n"] or 0) // SHARD_BYTES)
    schema = "chunk long, shard long, base long, gram binary, around binary, several binary, counts binary, places binary"
    blocks = save(rows.select("row", "text").mapInPandas(_find(n_shards), schema), "blocks")
    classes = blocks.select("shard", "chunk", "gram", "around", "several").groupBy("shard").applyInPandas(_classes, "shard long, chunk long, class binary")
    found = blocks.select("chunk", "shard", "base", "counts", "places").join(classes, ["shard", "chunk"])
    found = save(found.mapInPandas(_candidates, "chunk long, shard long, base long, class binary, places binary, sends array<struct<row:bigint,at:bigint,class:bigint>>"), "found")

    sends = found.select("shard", F.explode("sends").alias("s")).groupBy("s.row").agg(F.collect_list(F.struct("s.at", "shard", "s.class")).alias("sends"))
    splitters = _splitters(rows, found, n_shards)
    runs = rows.select("row", "text").join(sends, "row").select("text", "sends").mapInPandas(_sort(splitters), "part long, run long, n long, coded binary, tags binary")
    judged = save(runs.groupBy("part").applyInPandas(_judge, "shard long, class long, starts binary"), "judged")

    salts = max(1, blocks.select("chunk").distinct().count() // PLACES)
    left = found.select("shard", "base", "class", "places", F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("salt"))
    right = judged.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    spans = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(_spans, "row long, first long, last long")
    spans = spans.distinct().groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def finish(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [cut(t, [] if s is None else s) for t, s in zip(_bytes(text), spans, strict=True)]
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = rows.join(spans, "row", "left").select("doc_id", F.pandas_udf(finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")("text", "spans").alias("c"))
    return done.select("doc_id", "c.*")


def _splitters(rows: DataFrame, found: DataFrame, n_ranges: int) -> np.ndarray:
    """Grams that cut the suffixes sent into ranges of about one size, by a sample of SAMPLED suffixes a range.

    Repeated strings share the gram at their anchor, so a cut by whole grams never parts suffixes to be compared.
    """
    sends = found.select(F.explode("sends").alias("s")).select("s.row", "s.at")
    rate = max(1, sends.count() // (SAMPLED * n_ranges))
    picked = sends.filter(F.pmod(F.xxhash64("row", "at"), F.lit(rate)) == 0).groupBy("row").agg(F.collect_list("at").alias("at"))
    known = small_join(rows.select("row", F.encode("text", "UTF-8").alias("b")), save(picked, "picked"), "row", "inner")
    grams = known.select(F.explode(F.transform("at", lambda p: F.substring("b", p.cast("int") + 1, GRAM))).alias("gram"))
    heads = sorted(bytes(r.gram) for r in grams.collect())
    return np.array(sorted(set(heads[SAMPLED::SAMPLED])), dtype=f"S{GRAM}")

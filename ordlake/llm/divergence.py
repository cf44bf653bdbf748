"""Operator 13: how far the sources of a language differ in their words.

Documents become terms (runs of letters and of characters beyond ASCII; only A-Z is lower-cased). Every task counts the
terms of its documents by language and source, with document frequencies, and writes these partial counts once. Their
frequencies fill count-min sketches, one a task, which are merged; a count-min sketch never says less than the true
frequency, so a term whose merged estimate is below MIN_DOCS cannot be kept and is dropped before anything is shuffled by
term. Survivors are counted exactly. With p = 1 + floor(10^9 (count + 1) / (N + V)) for each kept term, where N is
the group's count of kept terms and V the number kept in the language, f = floor((p - q)^2 / q).

The sum over all kept terms for a pair (a, b) of sources never touches the terms that neither has: with p0 the
value of an absent term and |a| the number of terms of a,

    sum = sum over a of f(p, p0b) + sum over b of f(p0a, q) + (V - |a| - |b|) f(p0a, p0b)
          + sum over terms of both of f(p, q) - f(p, p0b) - f(p0a, q) + f(p0a, p0b).

The first two sums need only how often each p occurs in a source; the last is a join of blocks (about BLOCK terms by
up to SOURCES sources, packed as arrays), so neither a row for each pair and term nor a hot term's group is ever built.

Defined results: null text, lang or source is the empty string; repeated rows are documents of their own; a source without
terms has the value of an absent term everywhere; a language without kept terms has pairs of value 0 and no term rows;
equal values are ranked by the item's UTF-8 bytes; very long texts are split piece by piece; an empty table gives an
empty result; other columns of the table are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: A kept term stands in this many documents of its language; term rows go to this rank.
MIN_DOCS, TOP_TERMS = 3, 200
#: A task writes its counts when it holds so many terms; texts are split in pieces of so many bytes.
HELD, PIECE = 1_000_000, 1 << 20
#: The sketch: rows, largest width (64 MB in all; beyond about as many terms more survive, results stay exact), tasks
#: that fill one, cells of a piece that is merged.
DEPTH, MAX_WIDTH, FILLERS, SEGMENT = 4, 1 << 24, 512, 1 << 14
#: Kept terms and sources of a block.
BLOCK, SOURCES = 8192, 64

_SPLIT = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTS = "lang string, term string, docs long, sources array<string>, counts array<bigint>"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time; no term is cut."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(_SPLIT)
        at += len(piece)
        if at < len(text) and piece[-1] != 32:  # the last term may go on
            tail = bytearray()
            while at < len(text):
                more = text[at : at + PIECE].translate(_SPLIT)
                end = more.find(b" ")
                tail += more if end < 0 else more[:end]
                at += len(more) if end < 0 else end
                if end >= 0:
                    break
            piece += bytes(tail)
        yield piece.split()


def _flush(held: dict[str, tuple[Counter, dict[str, Counter]]]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a language, with its counts by source."""
    for lang, (docs, sources) in held.items():
        words = list(docs)
        place = dict(zip(words, range(len(words)), strict=True))
        at = [np.fromiter(map(place.__getitem__, n), np.int64, len(n)) for n in sources.values()]
        order = np.argsort(np.concatenate(at), kind="stable") if at else np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(at), dtype=np.int32), [len(x) for x in at])[order]
        counts = np.concatenate([np.fromiter(n.values(), np.int64, len(n)) for n in sources.values()])[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(at), minlength=len(words)))])
        names = pa.array(list(sources), pa.string())
        for i in range(0, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            cut = ends[i : i + len(part) + 1]
            offsets = pa.array((cut - cut[0]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, names.take(pa.array(own[cut[0] : cut[-1]]))), pa.ListArray.from_arrays(offsets, pa.array(counts[cut[0] : cut[-1]]))]
            columns = [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([docs[w] for w in part], pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs", "sources", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[Counter, dict[str, Counter]]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            docs, sources = held.setdefault(lang, (Counter(), {}))
            n = sources.setdefault(source, Counter())
            had, own = len(n), set()
            for words in terms(text.as_py()):
                n.update(words)
                own.update(words)
            docs.update(own)
            size += len(n) - had
            if size >= HELD:
                yield from _flush(held)
                held, size = {}, 0
    yield from _flush(held)


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, sources, counts): the terms of each task's documents; not yet merged over tasks."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    return rows.mapInArrow(_count, _COUNTS)


def _cells(h: np.ndarray, width: int) -> np.ndarray:
    """A cell of each sketch row for every 64-bit hash, numbered through all rows."""
    h = h.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(31)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) % np.uint64(width)).astype(np.int64) + i * width for i in range(DEPTH)], axis=1)


def sketch(frequencies: DataFrame, width: int) -> bytes:
    """The merged count-min sketch of (hash, frequency) rows; cells stop at MIN_DOCS, all that is asked of them."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(DEPTH * width, np.uint8)
        for batch in batches:
            n = np.repeat(np.minimum(batch.column(1).to_numpy(), MIN_DOCS), DEPTH)
            at, which = np.unique(_cells(batch.column(0).to_numpy(), width).ravel(), return_inverse=True)
            cells[at] = np.minimum(cells[at] + np.bincount(which, n), MIN_DOCS)
        for s in range(0, len(cells), SEGMENT):
            if cells[s : s + SEGMENT].any():
                yield pa.RecordBatch.from_pydict({"segment": [s // SEGMENT], "data": [zlib.compress(cells[s : s + SEGMENT].tobytes(), 1)]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SEGMENT, np.int64)
        for data in group["data"]:
            part = np.frombuffer(zlib.decompress(data), np.uint8)
            total[: len(part)] = np.minimum(total[: len(part)] + part, MIN_DOCS)
        return pd.DataFrame({"segment": group["segment"].iloc[:1], "data": [zlib.compress(total.astype(np.uint8).tobytes(), 1)]})

    merged = frequencies.coalesce(FILLERS).mapInArrow(fill, "segment long, data binary").groupBy("segment").applyInPandas(merge, "segment long, data binary")
    out = np.zeros(max(DEPTH * width, SEGMENT), np.uint8)
    for row in merged.toLocalIterator():
        out[row.segment * SEGMENT :][:SEGMENT] = np.frombuffer(zlib.decompress(row.data), np.uint8)
    return out[: DEPTH * width].tobytes()


def possibly_kept(spark, cells: bytes):
    """A function of a term's hash: false only where its document frequency is surely below MIN_DOCS."""
    shared, width = spark.sparkContext.broadcast(cells), len(cells) // DEPTH

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series((np.frombuffer(shared.value, np.uint8)[_cells(h.to_numpy(), width)] >= MIN_DOCS).all(axis=1))

    return test


def _p(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)) without overflow; 1 where nothing is kept."""
    ratio = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), F.nullif(total + kept, F.lit(0)).cast("decimal(20,0)"))
    return F.coalesce(ratio, F.lit(0)) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(lp: np.ndarray, l0: np.ndarray, rp: np.ndarray, r0: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For every left source what the terms of both add to its sum with each right source; 0 in lp, rp is absent."""
    f = lambda p, q: (p - q) ** 2 // q
    for i in range(lp.shape[1]):
        here = lp[:, i] > 0
        p, q = lp[here, i][:, None], rp[here]
        has = q > 0
        q = np.where(has, q, 1)
        yield i, np.where(has, f(p, q) - f(p, r0) - f(l0[i], q) + f(l0[i], r0), 0).sum(axis=0)


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over the shared terms of the sources of two blocks, both ways."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            sides = []
            tids = np.intersect1d(row.l_tid, row.r_tid)
            for tid, idx, p, p0 in ((row.l_tid, row.l_idx, row.l_p, row.l_p0), (row.r_tid, row.r_idx, row.r_p, row.r_p0)):
                own, first, column = np.unique(idx, return_index=True, return_inverse=True)
                table = np.zeros((len(tids), len(own)), np.int64)
                keep = np.isin(tid, tids)
                table[np.searchsorted(tids, tid[keep]), column[keep]] = p[keep]
                sides.append((own, table, p0[first]))
            (lo, lp, l0), (ro, rp, r0) = sides
            out = [(lo[i], ro, v) for i, v in _both(lp, l0, rp, r0)]
            if row.l_block != row.r_block:
                out += [(ro[i], lo, v) for i, v in _both(rp, r0, lp, l0)]
            for a, b, v in out:
                yield pd.DataFrame({"lang": row.lang, "a": a, "b": b, "value": v})


def audit(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part 'pair' for every other source, part 'term' for telling terms."""
    spark = docs.sparkSession
    partial = save(partial_counts(docs), "partial")
    h = F.xxhash64("lang", "term")
    width = 1 << max(14, min(MAX_WIDTH, partial.count()).bit_length() - 1)
    survives = possibly_kept(spark, sketch(partial.select(h, "docs"), width))
    parts = partial.filter(survives(h)).repartition("lang", "term")  # what follows up to counts stays in place
    each = F.transform(F.arrays_zip("sources", "counts"), lambda x, i: F.struct(x["sources"].alias("source"), x["counts"].alias("n"), F.when(i == 0, F.col("docs")).otherwise(0).alias("docs")))
    exact = parts.select("lang", "term", F.explode(each).alias("x")).groupBy("lang", "term", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"), F.sum("x.docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    over = {"total": F.sum("n").over(term), "in_docs": F.sum("docs").over(term), "tid": F.min("row").over(term), "k": F.row_number().over(term.orderBy("source"))}
    counts = exact.withColumn("row", F.monotonically_increasing_id()).withColumns(over).filter(F.col("in_docs") >= MIN_DOCS)
    counts = save(counts.select("lang", "source", "term", "n", "total", "tid", "k"), "counts")
    langs = counts.groupBy("lang").agg(F.count_if(F.col("k") == 1).alias("v"), F.sum("n").alias("all_n"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    sources = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = sources.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select("lang", "source", zero("v"), zero("all_n"), zero("size"), zero("own"))
    idx = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = save(groups.withColumn("idx", idx).withColumn("p0", _p(F.lit(0).cast("long"), F.col("size"), F.col("v"))), "groups")
    scored = counts.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("size"), F.col("v"))).withColumn("q", _p(F.col("total"), F.col("all_n"), F.col("v")))
    scored = save(scored.select("lang", "source", "term", "tid", "idx", "p", "q", "p0"), "scored")

    by = lambda item: Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc(item))
    telling = scored.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(by("item"))).filter(F.col("rank") <= TOP_TERMS)

    other = groups.select("lang", F.col("source").alias("item"), F.col("idx").alias("b"), F.col("own").alias("b_own"), F.col("p0").alias("b_p0"))
    spread = scored.groupBy("lang", "idx", "p").agg(F.count("*").alias("m")).join(other, "lang").filter("idx <> b")
    alone = spread.groupBy("lang", "idx", "b").agg(F.sum(F.col("m") * _f(F.col("p"), F.col("b_p0"))).alias("to"), F.sum(F.col("m") * _f(F.col("b_p0"), F.col("p"))).alias("back"))
    sums_of = alone.select("lang", F.col("idx").alias("a"), "b", F.col("to").alias("value")).unionByName(alone.select("lang", F.col("b").alias("a"), F.col("idx").alias("b"), F.col("back").alias("value")))
    blocks = max(1, -(-counts.filter("k = 1").count() // BLOCK))
    packed = scored.withColumn("part", F.pmod(F.xxhash64("tid"), F.lit(blocks))).withColumn("block", F.floor(F.col("idx") / SOURCES))
    packed = packed.groupBy("lang", "part", "block").agg(F.collect_list(F.struct("tid", "idx", "p", "p0")).alias("x"))
    side = lambda s: packed.select("lang", "part", F.col("block").alias(f"{s}_block"), *[F.col(f"x.{c}").alias(f"{s}_{c}") for c in ("tid", "idx", "p", "p0")])
    met = side("l").join(side("r"), ["lang", "part"]).filter("l_block <= r_block")
    common = met.mapInPandas(_shared, "lang string, a long, b long, value long").filter("a <> b")
    sums_of = sums_of.unionByName(common).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = groups.withColumnRenamed("idx", "a").join(other, "lang").filter("a <> b").join(sums_of, ["lang", "a", "b"], "left")
    rest = (F.col("v") - F.col("own") - F.col("b_own")) * _f(F.col("p0"), F.col("b_p0"))
    value = F.when(F.col("v") == 0, F.lit(0)).otherwise(F.coalesce("value", F.lit(0)) + rest)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(by("item"))).unionByName(telling)

"""Operator 5: mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. The table is raked: probabilities of cells are scaled to the target
tokens of every source, then language, then topic, until all marginals agree. Cells that would need a probability
over one are taken whole, what they bring is taken off the targets, and the other cells are raked again to the rest.
Documents are then sampled with the probability of their cell. The draw is a hash of the document, so it repeats on
every run and needs no shuffle.

Targets come from the caller: shares for the categories of each dimension. tempered() makes them from the table
itself: the TOP largest categories by tokens, with shares in proportion to tokens ** POWER. Any other value falls in
the category OTHER, so the table of cells has a bound that does not grow with the data. Only that table comes to the
driver. Topics are clusters of hashed words, with each language's mean taken off; weights, means and centres are sums over
all documents, in whole numbers, so they do not depend on how rows are dealt out. Every document is assigned to its nearest topic.

Defined results: a null text has no tokens; null categories are OTHER; a target category without tokens is dropped
and the remaining shares are scaled up; documents of cells without tokens are sampled at the overall share; cells
of a category without a target share are not sampled; repeated rows share one draw; an empty table gives an empty
result; where the targets contradict each other or the stock, allot() says by how much they are missed (gap) and a
warning is given; other columns are untouched, and where the input has a column of the result's name already, the
result's name gets underscores until it is free.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import free_name, new_column, passing, save, transient

OTHER = "(other)"
ROUNDS, TOLERANCE = 1000, 1e-6
#: Categories of a dimension that tempered() names, and the power of their tokens that gives their shares.
TOP, POWER = 64, 0.5
#: Share of all tokens that is asked for.
SHARE = 0.5
#: Topics, hashed word features, languages with a mean of their own, passes, and the whole number that stands for 1 in sums.
TOPICS, WIDTH, LANGUAGES, PASSES, ONE = 8, 1 << 10, 16, 20, 1 << 14
#: Documents whose vectors a task spreads out at a time.
ROWS = 1 << 10
#: Vectors are stored by the words that they have: place and weight, the root of a count or a whole number.
ROOTS, VECTOR = np.dtype([("p", "<u2"), ("w", "<f4")]), np.dtype([("p", "<u2"), ("w", "<i2")])
_COUNTED = pa.struct([("tokens", pa.int64()), ("roots", pa.binary())])
#: Bytes of text that are measured at a time, where texts are not longer.
PART = 1 << 20

# White space between words.
SPACE = b" \t\n\x0b\x0c\r"
_SPACE = np.isin(np.arange(256), list(SPACE))


@dataclass
class Topics:
    idf: np.ndarray
    means: dict[str, np.ndarray]
    centres: np.ndarray

    def nearest(self, vectors: np.ndarray, langs: list[str | None]) -> np.ndarray:
        names = list(self.means)
        at = {x: i for i, x in enumerate(names)}
        mean = np.stack([self.means[x] for x in names])[[at.get(x or "", at[""]) for x in langs]]
        return ((_unit(vectors * self.idf) - mean) @ self.centres.T).argmax(axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def word_roots(texts: list[bytes]) -> pa.Array:
    """Square roots of the counts of hashed words, as the bytes of one array of ROOTS for each text."""
    entries, sizes = [np.zeros(0, ROOTS)], [np.zeros(0, np.int64)]
    for own, h, counts in bytehash.word_hashes(texts):
        place = np.repeat(np.arange(len(own)) * WIDTH, counts) + (h % np.uint64(WIDTH)).astype(np.int64)
        count = np.bincount(place, minlength=len(own) * WIDTH)
        at = np.flatnonzero(count)
        part = np.empty(len(at), ROOTS)
        part["p"], part["w"] = at % WIDTH, np.sqrt(count[at])
        entries.append(part)
        sizes.append(np.bincount(at // WIDTH, minlength=len(own)))
    return _packed(np.concatenate(entries), np.concatenate(sizes))


def _packed(entries: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The entries of consecutive rows as one binary value for each row."""
    offsets = (np.concatenate([[0], np.cumsum(sizes)]) * entries.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(entries)])


def _entries(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, weight) of every entry of a packed column."""
    data, offsets = bytehash.buffers(column)
    e = data.view(kind)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // kind.itemsize), e["p"].astype(np.int64), e["w"]


def _dense(own: np.ndarray, place: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, WIDTH), np.float32)
    out[own, place] = weight
    return out


def word_vectors(texts: list[bytes]) -> np.ndarray:
    """Square roots of the counts of hashed words, one row for each text."""
    return _dense(*_entries(word_roots(texts), ROOTS), len(texts))


def _by_rows(column: pa.Array, fn, kind: pa.DataType) -> pa.Array:
    """fn(rows, index of the first) over ROWS rows of a column at a time."""
    parts = [fn(column.slice(i, ROWS), i) for i in range(0, len(column), ROWS)]
    bytehash.give_back()
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


Part = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _parts(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[Part]:
    """(row, place, weight) of the entries, and the languages and hashes of the rows, of ROWS documents at a time."""
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            part = batch.slice(i, ROWS)
            yield *_entries(part.column("v"), kind), part.column("lang").to_numpy(), part.column("by").to_numpy()


def _sums(rows: DataFrame, kind: np.dtype, langs: list[str], weigh=lambda own, place, weight, lang: (0, weight), n_groups: int = 1) -> dict[tuple[int, str], tuple[np.ndarray, int]]:
    """(sum, count) of the vectors by (group, language); weigh gives the group of each row of a part and the weight of each entry.

    A task makes one row of sums for each group and language, whatever the number of its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = n_groups * len(langs)
        total = np.zeros((n, WIDTH + 1), np.int64)
        for own, place, weight, lang, _ in _parts(batches, kind):
            group, weight = weigh(own, place, weight, lang)
            code = group * len(langs) + lang
            total[:, :WIDTH] += np.bincount(code[own] * WIDTH + place, weight, n * WIDTH).reshape(n, WIDTH).astype(np.int64)
            total[:, WIDTH] += np.bincount(code, minlength=n)
        held = np.flatnonzero(total[:, WIDTH])
        yield pa.record_batch({"k": pa.array(held, pa.int32()), "s": pa.array([total[k].tobytes() for k in held], pa.binary())})

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(WIDTH + 1, np.int64)
        for s in part.column("s"):
            total += np.frombuffer(s.as_py(), np.int64)
        return pa.table({"k": part.column("k").slice(0, 1), "s": pa.array([total.tobytes()], pa.binary())})

    out = {}
    for r in rows.mapInArrow(run, "k int, s binary").groupBy("k").applyInArrow(add, "k int, s binary").collect():
        total = np.frombuffer(r.s, np.int64)
        out[r.k // len(langs), langs[r.k % len(langs)]] = total[:WIDTH], int(total[WIDTH])
    return dict(sorted(out.items()))


def _measured(text: pa.Array) -> pa.Array:
    """The words between white space and the word_roots of each text."""
    some = lambda t: pa.StructArray.from_arrays([pa.array(_tokens(t)), word_roots(t.cast(pa.large_binary()).to_pylist())], fields=list(_COUNTED))
    return bytehash.by_bytes(text, some, _COUNTED, PART, 512)


def _counted(text_col: str) -> Column:
    return F.arrow_udf(_measured, "struct<tokens:bigint,roots:binary>")(F.coalesce(text_col, F.lit("")))


def _by(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


@transient
def fit_topics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Topics:
    """Topics of all documents: spherical k-means that begins with the document of the least hash and those least like the ones before."""
    return _fit(save(docs.select(_by(id_col, text_col).alias("by"), F.col(lang_col).alias("lang"), _counted(text_col)["roots"].alias("v")), "roots"))


@transient
def _fit(rows: DataFrame) -> Topics:
    """fit_topics() of a written table of hashes, languages and word_roots (by, lang, v)."""
    every = rows.withColumn("lang", F.coalesce("lang", F.lit("")))
    most = every.filter("lang <> ''").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    langs = sorted({"", *[r.lang for r in most]})
    code = F.coalesce(*[F.when(F.col("lang") == x, i) for i, x in enumerate(langs)], F.lit(0))  # the first is ""
    every = every.withColumn("lang", code.cast("int"))
    having = _sums(every, ROOTS, langs, lambda own, place, weight, lang: (0, None))
    n = sum(c for _, c in having.values())
    idf = np.log((n + 1) / (sum((v for v, _ in having.values()), np.zeros(WIDTH, np.int64)) + 1)).astype(np.float32) + 1

    def whole(roots: pa.Array, _: int) -> pa.Array:
        own, place, weight = _entries(roots, ROOTS)
        out = np.empty(len(own), VECTOR)
        out["p"], out["w"] = place, np.rint(_unit(_dense(own, place, weight, len(roots)) * idf) * ONE)[own, place]
        return _packed(out, np.bincount(own, minlength=len(roots)))

    vector = F.arrow_udf(lambda roots: _by_rows(roots, whole, pa.binary()), "binary")
    vectors = save(every.select("by", "lang", vector("v").alias("v")), "vectors")

    by_lang = {k: v for (_, k), v in _sums(vectors, VECTOR, langs).items()}
    mean = lambda v, c: (v / max(c, 1) / ONE).astype(np.float32)
    means = {k: mean(*v) for k, v in by_lang.items() if k} | {"": mean(sum((v for v, _ in by_lang.values()), np.zeros(WIDTH, np.int64)), n)}
    all_means = np.stack([means[k] for k in langs])
    bare = lambda x, lang: x / np.float32(ONE) - all_means[lang]

    def likeness(x: np.ndarray, lang: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """bare(x) @ centres.T"""
        return x @ centres.T / np.float32(ONE) - (all_means @ centres.T)[lang]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for own, place, weight, lang, by in _parts(batches, VECTOR):
            i = np.lexsort((lang, by))[0]
            x = _dense(np.zeros(np.count_nonzero(own == i), np.int64), place[own == i], weight[own == i], 1)
            best = min([(int(by[i]), int(lang[i]), x.tobytes()), *([best] if best else [])])
        if best:
            yield pa.record_batch({"by": [best[0]], "lang": pa.array([best[1]], pa.int32()), "v": pa.array([best[2]], pa.binary())})

    r = vectors.mapInArrow(begin, "by long, lang int, v binary").orderBy("by", "lang", "v").first()
    centres = _unit(bare(np.frombuffer(r.v, np.float32)[None], [r.lang]) if r else np.zeros((1, WIDTH), np.float32))
    while len(centres) < min(TOPICS, n):  # the document that is least like every centre begins the next

        def least(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            best = None
            for own, place, weight, lang, by in _parts(batches, VECTOR):
                x = _dense(own, place, weight, len(by))
                like = likeness(x, lang, centres)
                to_mean = x @ all_means.T / np.float32(ONE)
                size = (np.einsum("ij,ij->i", x, x) / np.float32(ONE) ** 2) - 2 * to_mean[np.arange(len(x)), lang] + (all_means**2).sum(axis=1)[lang]
                like = np.round((like.max(axis=1) / np.sqrt(np.maximum(size, 1e-9))).astype(np.float64), 4)
                i = np.lexsort((by, like))[0]
                best = min([(like[i], int(by[i]), _unit(bare(x[i : i + 1], lang[i : i + 1]))[0].tobytes()), *([best] if best else [])])
            if best:
                yield pa.record_batch({"like": [best[0]], "by": [best[1]], "v": pa.array([best[2]], pa.binary())})

        r = vectors.mapInArrow(least, "like double, by long, v binary").orderBy("like", "by", "v").first()
        centres = np.concatenate([centres, np.frombuffer(r.v, np.float32)[None]])
    for _ in range(PASSES if n else 0):
        near = lambda own, place, weight, lang, centres=centres: (likeness(_dense(own, place, weight, len(lang)), lang, centres).argmax(axis=1), weight)
        own = _sums(vectors, VECTOR, langs, near, len(centres))
        sums = centres.astype(np.float64)
        for k in {k for k, _ in own}:
            sums[k] = sum(v / ONE - c * means[g].astype(np.float64) for (j, g), (v, c) in own.items() if j == k)
        last, centres = centres, _unit(sums).astype(np.float32)
        if (centres == last).all():
            break
    return Topics(idf, means, centres)


def _tokens(text: pa.Array) -> np.ndarray:
    """Words between white space of each text, in a few passes over the bytes of many texts."""
    data, offsets = bytehash.buffers(text)
    space = _SPACE[data]
    starts = offsets[:-1][np.diff(offsets) > 0]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[starts] = ~space[starts]
    return np.diff(np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])[offsets])


def _topic(docs: DataFrame, topics: Topics, roots: Column, lang: Column) -> Column:
    """The topic's number of each row by its word_roots and language."""
    shared = docs.sparkSession.sparkContext.broadcast(topics)

    def run(roots: pa.Array, lang: pa.Array) -> pa.Array:
        near = lambda x, i: pa.array(shared.value.nearest(_dense(*_entries(x, ROOTS), len(x)), lang.slice(i, len(x)).to_pylist()).astype(np.int32))
        return _by_rows(roots, near, pa.int32())

    return F.arrow_udf(run, "int")(roots, lang)


def measure(docs: DataFrame, topics: Topics, text_col: str = "text", lang_col: str = "lang", out_col: str = "measure") -> DataFrame:
    """docs with a struct of the words between white space and the topic's number of each text."""
    name = free_name(docs, "__counted")
    counted = docs.withColumn(name, _counted(text_col))
    found = F.struct(F.col(name)["tokens"].alias("tokens"), _topic(docs, topics, F.col(name)["roots"], F.col(lang_col)).alias("topic"))
    return new_column(counted, out_col, found).drop(name)


def tempered(sized: DataFrame, dimensions: dict[str, Column], tokens: Column, power: float = POWER, top: int = TOP) -> dict[str, dict[str, float]]:
    """Targets for each dimension: its top categories by tokens, and OTHER, in proportion to tokens ** power."""
    out = {}
    for name, column in dimensions.items():
        count = sized.groupBy(column.cast("string").alias("c")).agg(F.sum(tokens).cast("double").alias("n"))
        total = count.agg(F.sum("n")).first()[0] or 0.0
        named = {r.c: r.n for r in count.filter("c is not null and n > 0").orderBy(F.desc("n"), "c").limit(top).collect()}
        rest = total - sum(named.values())
        out[name] = {c: n**power for c, n in (named | ({OTHER: rest} if rest > 0 else {})).items()}
    return out


@dataclass
class Allotment:
    """Probability of each cell, and for every dimension the target and the expected share of each category."""

    probability: dict[tuple, float]
    marginals: list[tuple[int, str, float, float]]
    gap: float


def _rake(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], start: float) -> np.ndarray:
    """Probabilities whose expected tokens reach the goals of every category, as far as they can be reached."""
    p = np.full(len(tokens), start)
    for _ in range(ROUNDS):
        off = 0.0
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, p * tokens, len(goal))
            off = max(off, float(np.abs(now - goal)[now > 0].max(initial=0.0)) / max(goal.sum(), 1e-300))
            p = p * np.where(now > 0, goal / np.maximum(now, 1e-300), 1.0)[code]
        if off < TOLERANCE / 10:
            break
    return p


def allot(cells: dict[tuple, float], targets: list[dict[str, float]], share: float) -> Allotment:
    """Rake the cells' tokens to share of them all, split by the targets; no probability is over one."""
    present = [{k[d] for k, v in cells.items() if v > 0} for d in range(len(targets))]
    shares = [{c: t[c] for c in sorted(t) if c in own and t[c] > 0} for t, own in zip(targets, present, strict=True)]
    keys = sorted(k for k, v in cells.items() if v > 0 and all(k[d] in s for d, s in enumerate(shares)))
    tokens = np.array([cells[k] for k in keys])
    budget = share * sum(cells.values())
    names = [list(s) for s in shares]
    codes = [np.array([n.index(k[d]) for k in keys], dtype=np.int64) for d, n in enumerate(names)]
    goals = [np.array(list(s.values())) / sum(s.values()) * budget if s else np.zeros(0) for s in shares]
    p, free = np.zeros(len(keys)), np.ones(len(keys), bool)
    while free.any():
        taken = p * tokens * ~free
        rest = max(budget - taken.sum(), 0.0)
        left = [np.maximum(g - np.bincount(c, taken, len(g)), 0) * (np.bincount(c, free, len(g)) > 0) for c, g in zip(codes, goals, strict=True)]
        left = [g / g.sum() * rest if g.sum() > 0 else g for g in left]
        p[free] = _rake(tokens[free], [c[free] for c in codes], left, share)
        over = free & (p > 1)
        if not over.any():
            break
        p[over], free = 1.0, free & ~over
    expected = [np.bincount(c, p * tokens, len(g)) for c, g in zip(codes, goals, strict=True)]
    marginals = [(d, n, float(g / budget), float(e / budget)) for d in range(len(names)) for n, g, e in zip(names[d], goals[d], expected[d], strict=True)] if budget else []
    gap = max((abs(a - b) for _, _, a, b in marginals), default=0.0)
    return Allotment({k: share for k, v in cells.items() if v <= 0} | {k: 0.0 for k, v in cells.items() if v > 0} | dict(zip(keys, p.tolist(), strict=True)), marginals, gap)


def cell_of(dimensions: dict[str, Column], targets: dict[str, dict[str, float]]) -> Column:
    """The cell of a row as an array of categories."""
    return F.array(*[F.when(c.cast("string").isin([x for x in targets[d] if x != OTHER]), c.cast("string")).otherwise(OTHER) for d, c in dimensions.items()])


def allotment_of(docs: DataFrame, dimensions: dict[str, Column], targets: dict[str, dict[str, float]], tokens: Column, share: float) -> Allotment:
    """allot() over the counted cells of docs."""
    counted = docs.groupBy(cell_of(dimensions, targets).alias("cell")).agg(F.sum(tokens).cast("double").alias("n")).collect()
    out = allot({tuple(r.cell): r.n or 0.0 for r in counted}, [targets[d] for d in dimensions], share)
    if out.gap > TOLERANCE:
        warnings.warn(f"targets are missed by up to {out.gap:.4f} of the budget: {[m for m in out.marginals if abs(m[2] - m[3]) > TOLERANCE][:20]}", stacklevel=2)
    return out


def mix(docs: DataFrame, dimensions: dict[str, Column], targets: dict[str, dict[str, float]], tokens: Column, share: float, id_col: str = "doc_id", seed: int = 1, out_col: str = "mix", sized: DataFrame | None = None) -> DataFrame:
    """docs with a struct<tokens, cell, weight, probability, selected>; weight is the probability over the greatest one.

    dimensions gives the column of each dimension, targets its shares (OTHER included where wanted), tokens the
    size of a row, and share the part of all tokens that is asked for. sized may be a written table of these columns
    of docs alone, which is cheaper to sum.
    """
    chance = allotment_of(docs if sized is None else sized, dimensions, targets, tokens, share).probability
    top = max(chance.values(), default=0.0) or 1.0
    name = free_name(docs, out_col)
    key, value = free_name(docs, "__cell"), free_name(docs, "__probability")
    cells = docs.sparkSession.createDataFrame([(list(k), chance[k]) for k in sorted(chance)], f"`{key}` array<string>, `{value}` double")
    held = docs.withColumn(key, cell_of(dimensions, targets)).join(F.broadcast(cells), key, "left")  # at most (TOP + 1) ** 2 * TOPICS cells
    p = F.coalesce(F.col(value), F.lit(0.0))
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") * 2.0**-53
    found = F.struct(tokens.cast("long").alias("tokens"), F.col(key).alias("cell"), (p / top).alias("weight"), p.alias("probability"), (draw < p).alias("selected"))
    return held.withColumn(name, found).select(*[F.col(f"`{c}`") for c in docs.columns], name)


def mix_documents(docs: DataFrame, out_col: str = "mix", share: float = SHARE, stored=save) -> DataFrame:
    """mix() of a table of documents by source, language and topic with tempered targets; all columns stay.

    stored writes and reads back the table with its measures, so that texts are measured once; it may drop columns
    that the result need not have.
    """
    key, name, topic, n = (free_name(docs, x) for x in ("__by", "__counted", "__topic", "__tokens"))
    counted = stored(docs.withColumn(key, _by("doc_id", "text")).withColumn(name, _counted("text")))
    roots = F.col(name)["roots"]
    topics = _fit(counted.select(F.col(key).alias("by"), "lang", roots.alias("v")))
    measured = counted.withColumn(topic, _topic(docs, topics, roots, F.col("lang"))).withColumn(n, F.col(name)["tokens"]).drop(key, name)
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(topic)}
    with passing(docs.sparkSession):  # the result does not read sized
        sized = save(measured.select("source", "lang", topic, n), "sized")
        mixed = mix(measured, dimensions, tempered(sized, dimensions, F.col(n)), F.col(n), share, out_col=out_col, sized=sized)
    return mixed.drop(topic, n)

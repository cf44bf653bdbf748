"""Operator 3: near-duplicate detection with ProbMinHash.

A document is its multiset of five-word shingles, weighted by their counts. Each shingle starts a Poisson process
whose rate is its weight; arrivals fall on registers at random and every register keeps its earliest arrival, so
two documents agree in a register with the probability Jaccard similarity of their weights. Arrivals are drawn in
windows of time and a document stops as soon as all its registers are filled. Bands of registers give buckets;
members of a bucket are compared with a few leaders first. Where that leaves a bucket in several clusters, all its
pairs across clusters are compared as well. Pairs whose registers agree are verified by the exact probability Jaccard
of the whole texts, and verified links are closed to clusters.

Equal texts are one class and compared once. Large buckets are reduced in each task; they, and leaders with many
members, are joined by broadcast (a bounded number), so a third of all rows may share one. Members with the same
first leader are verified in blocks of about PAIRS_CELL pairs, each with all its leaders, so of alike texts a member is sent once
and a leader once for each block. Registers stay where they were written: rows that stand for equal texts, members and
texts are picked by bitmaps of their numbers, and of buckets only the shared ones are shuffled. What the leaders leave is compared in cells of a grid of
at most about 2 * CELL members, so no task holds a bucket. Cells receive members, never pairs: pairs are formed,
verified and dropped inside a cell. The work grows with the bucket's size times the number of its members outside
its largest cluster; the rows sent grow by a CELL-th of that.

Defined results: a null text is empty; texts without words equal only identical texts; texts of under five words
are one shingle; the least doc_id of a cluster stays (null is the least); of repeated rows one stays; an empty
table gives an empty result; columns of any name are carried along. The rows are numbered and written first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import BROADCAST_ROWS, PACKED, bitmaps, components, free_name, key_join, marked, numbered, save, settled

SHINGLE, SIMILARITY = 5, 0.8
#: 16 bands of 4 registers: a pair of similarity 0.8 is missed with probability 0.0002.
BANDS, ROWS = 16, 4
REGISTERS = BANDS * ROWS
#: Leaders of a bucket with which its members are compared first.
LEADERS = 8
#: Pairs of members and leaders that are verified together, and members of a side of a cell, in which the rest of a bucket is compared.
PAIRS_CELL, CELL = 1024, 1024
#: Pairs whose registers agree less are not verified; at similarity 0.8 that is 3.6 standard errors below.
ESTIMATE = 0.62
#: Bits of the filter of shared buckets: so many for each, and at most so many in all (32 MB).
BUCKET_BITS, FILTER_BITS = 32, 1 << 28
#: Texts hashed at a time: at most so many and so many bytes.
PAIRS, PAIR_BYTES = 512, 1 << 22

_MIX = bytehash.mix


def shingles(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of a block of texts, by document and shingle; 48-bit shingles."""
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(h)
    total = np.zeros(n, dtype=np.uint64)
    inside = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.repeat(counts, counts)
    for j in range(SHINGLE):  # a word past the text's end adds nothing
        at = np.arange(n) + j
        ok = inside + j < size
        part = np.where(ok, h[np.minimum(at, max(n - 1, 0))], np.uint64(0))
        total = total * np.uint64(0x2545F4914F6CDD1D) + part
    full = (inside + SHINGLE <= size) | (inside == 0)
    key = np.sort((doc[full].astype(np.uint64) << np.uint64(48)) | (_MIX(total[full]) >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(first, append=len(key))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), weight


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """REGISTERS values of every document that has shingles."""
    m = REGISTERS
    total = np.bincount(doc, weight, n_docs)
    horizon = np.where(total > 0, m * (np.log(m) + 3) / np.maximum(total, 1), 0)
    time, value = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, dtype=np.uint64)

    def wait(u: np.ndarray) -> np.ndarray:
        return -np.log1p(-((u >> np.uint64(11)).astype(np.float64) * 2.0**-53))

    def draw(k: np.ndarray, arrival: np.ndarray) -> np.ndarray:
        return _MIX(k ^ _MIX(arrival.astype(np.uint64) * bytehash.BASE + np.uint64(1)))

    number = np.zeros(len(key), dtype=np.int64)
    u = draw(key, number)
    at = wait(u) / weight
    todo = np.flatnonzero(at < horizon[doc])
    while True:
        while len(todo):
            slot = doc[todo] * m + (_MIX(u[todo]) >> np.uint64(58)).astype(np.int64) % m
            early = at[todo] < time[slot]
            own, slot = todo[early], slot[early]
            order = np.argsort(-at[own])  # of one register the earliest is written last
            time[slot[order]], value[slot[order]] = at[own[order]], key[own[order]]
            number[todo] += 1
            u[todo] = draw(key[todo], number[todo])
            at[todo] += wait(u[todo]) / weight[todo]
            todo = todo[at[todo] < horizon[doc[todo]]]
        open_docs = np.isinf(time.reshape(n_docs, m)).any(axis=1) & (total > 0)
        if not open_docs.any():
            return value.reshape(n_docs, m)
        horizon[open_docs] *= 2
        todo = np.flatnonzero(open_docs[doc] & (at < horizon[doc]))


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets, given as (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    v, w = a[1][i].astype(float), b[1][j].astype(float)
    only_a, only_b = a[1].sum() - v.sum(), b[1].sum() - w.sum()
    if (v == w).all():
        return float((v / (v.sum() + only_a + only_b)).sum())
    ratio = v / w
    order = np.argsort(ratio, kind="stable")
    v, w, ratio = v[order], w[order], ratio[order]
    lower = np.searchsorted(ratio, ratio, side="left")
    above = v.sum() - np.concatenate([[0], np.cumsum(v)])[lower] + only_a
    below = np.concatenate([[0], np.cumsum(w)])[lower] + only_b
    return float((1 / (above / v + below / w)).sum())


_SIGNED = "struct<key:binary,registers:binary>"


def _sign(text: pa.Array) -> pa.Array:
    """Key of equal texts and the registers' low 16 bits; some texts at a time are taken from the batch."""
    kind = pa.struct([("key", pa.binary()), ("registers", pa.binary())])
    parts = []
    for i, j in bytehash.slices(bytehash.sizes(text), PAIR_BYTES, PAIRS):
        some = _sign_some(text.slice(i, j - i).cast(pa.large_binary()).to_pylist())
        parts.append(pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(some, kind, strict=True)], fields=list(kind)))
    bytehash.give_back()
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _sign_some(texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    registers = [b""] * len(texts)
    for own, h, counts in bytehash.word_hashes(texts):
        doc, key, weight = shingles(h, counts)
        value = signatures(doc, key, weight, len(own)).astype(np.uint16)
        for k, i in enumerate(own):
            if counts[k]:
                registers[i] = value[k].tobytes()
    return [hashlib.blake2b(t, digest_size=16).digest() for t in texts], registers


def _bands() -> Column:
    """The bands of a document: hashes of ROWS registers each; a text without words has none."""
    part = [F.xxhash64(F.substring("registers", 2 * ROWS * k + 1, 2 * ROWS), F.lit(k)) for k in range(BANDS)]
    return F.when(F.length("registers") > 0, F.array(*part))


def _agreement(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of equal registers."""
    a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (left, right))
    return pd.Series((a == b).mean(axis=1))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, cluster_id, cluster_size, kept.

    class_id and cluster_id are the least doc_id of equal texts and of the cluster.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "row", codec=PACKED)
    return _clusters(rows).drop("row")


def _clusters(rows: DataFrame) -> DataFrame:
    """near_duplicates() of a written table doc_id, text, row (a number); row is returned as well."""
    signed = save(rows.select("doc_id", "row", F.arrow_udf(_sign, _SIGNED)("text").alias("s")).select("doc_id", "row", "s.*"), "signed")
    n = signed.count()
    classes = save(signed.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("size")), "classes")
    classes = classes.withColumn("node", F.col("first.row"))
    links = settled(rows.sparkSession, lambda: _links(rows.select("row", "text"), _picked(signed.select(F.col("row").alias("node"), "registers"), classes)), "links")

    def place() -> DataFrame:
        placed = save(classes.select("key", "node", "size", "first").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
        clusters = save(placed.groupBy("component").agg(F.min("first").alias("best"), F.sum("size").alias("cluster_size")), "clusters")
        return key_join(placed, clusters, "component", "cluster_size", n)

    placed = settled(rows.sparkSession, place, "placed")
    out = key_join(signed.select("doc_id", "row", "key"), placed, "key", "size", n)
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), F.col("best.doc_id").alias("cluster_id"), "cluster_size", (F.col("row") == F.col("best.row")).alias("kept"), "row")


def _picked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (node, ...) whose node is in the column node of another table."""
    return marked(rows, F.col("node"), save(bitmaps(nodes.select("node")), "picked"))


def _links(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links (a, b, similarity) between classes (node, registers); row of texts and node of classes agree."""
    spark = texts.sparkSession
    shared = settled(spark, lambda: _shared_buckets(classes.select("node", _bands().alias("bands"))), "shared")
    buckets, n = shared.drop("n"), shared.count()
    classes = save(_picked(classes, buckets), "members")
    order = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("by"), "node")).alias(f"l{k}")
    leaders = shared.groupBy("band").agg(F.first("n").alias("n"), *[order(k) for k in range(LEADERS)])
    leaders = save(leaders.select("band", "n", F.array_distinct(F.array(*[f"l{k}.node" for k in range(LEADERS)])).alias("leaders")), "leaders")
    links = settled(spark, lambda: _verified(settled(spark, lambda: _led_pairs(buckets, leaders, n, classes), "pairs"), texts), "led")
    open_buckets = leaders.filter(F.col("n") > F.size("leaders") + 1)  # pairs of members that are both no leaders
    rest = key_join(buckets, open_buckets, "band", "n", n).filter(~F.array_contains("leaders", F.col("node"))).select("band", "k", "node")
    return links.unionByName(_rest_links(rest, links, texts, classes))


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """(band, node, k, n) of the members of buckets of two and more.

    Most buckets have one member: buckets are counted by half their bits, and a filter of those that occur again keeps
    the others from the shuffle. What it lets through is counted exactly.
    """
    buckets = classes.select("node", F.posexplode("bands").alias("k", "band"))
    low = lambda mask: F.col("band").bitwiseAND(F.lit(mask))
    again = save(buckets.groupBy(low((1 << 32) - 1).alias("band")).agg(F.count("*").alias("n")).filter("n > 1").select("band"), "again")
    bits = min(FILTER_BITS, 1 << max(15, (BUCKET_BITS * again.count()).bit_length()))
    seen = save(bitmaps(again.select(low(bits - 1))), "seen")
    some = save(marked(buckets, low(bits - 1), seen), "buckets")
    sizes = save(some.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    return key_join(some, sizes, "band", "n", some.count())


def _led_pairs(buckets: DataFrame, leaders: DataFrame, n: int, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a leader and a member of its bucket whose registers agree, in cells (cell)."""
    met = key_join(buckets, leaders, "band", "n", n).select(F.col("node").alias("member"), F.explode("leaders").alias("leader")).filter("member <> leader")
    met = save(met.groupBy("member").agg(F.collect_set("leader").alias("leaders")), "met")  # at most BANDS * LEADERS of each
    own = lambda name: classes.select(F.col("node").alias(name), F.col("registers").alias(f"r_{name}"))
    led = met.select("member", F.explode("leaders").alias("leader"))
    told = save(led.groupBy("leader").agg(F.count("*").alias("m")).join(own("leader"), "leader"), "told")
    near = key_join(met.join(own("member"), "member").withColumn("leader", F.explode("leaders")).drop("leaders"), told, "leader", "m", led.count())
    near = near.withColumn("agree", F.pandas_udf(_agreement, "double")("r_member", "r_leader")).filter(F.col("agree") >= ESTIMATE)
    near = save(near.select("member", "leader"), "near")
    # all pairs of a member stand with those of the other members that have the same first leader, so many at a time
    # as are about PAIRS_CELL pairs; of a pair that leads both ways one is enough
    first = lambda c: F.struct(F.xxhash64(c, F.lit(0)).alias("by"), F.col(c).alias("to"))
    tops = save(near.groupBy("member").agg(F.least(F.min(first("leader")), first("member")).alias("top"), F.collect_set("leader").alias("leaders")).select("member", "leaders", "top.to"), "tops")
    sizes = save(tops.groupBy("to").agg(F.sum(F.size("leaders")).alias("m")), "blocks")
    dealt = key_join(tops, sizes, "to", "m", near.count())
    salt = F.pmod(F.xxhash64("member"), F.ceil(F.col("m") / PAIRS_CELL)).cast("long")
    dealt = dealt.select("member", F.xxhash64("to", salt).alias("cell"), F.explode("leaders").alias("leader"))
    return dealt.groupBy(F.least("member", "leader").alias("a"), F.greatest("member", "leader").alias("b")).agg(F.min("cell").alias("cell"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b, similarity) among pairs (a, b) of the cells (cell); a cell gets each of its texts once."""
    wanted = save(pairs.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sent = _sent(texts, wanted).select("cell", F.col("node").alias("row"), "text")
    return sent.groupBy("cell").cogroup(pairs.groupBy("cell")).applyInPandas(_verify, "a long, b long, similarity double")


def _sent(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of a written table (node, ...), one for each of its rows; where these are too many to be sent to every
    task, only texts that are wanted are shuffled."""
    few = wanted.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2
    some = _picked(texts.withColumnRenamed("row", "node"), wanted)
    return some.join(F.broadcast(wanted) if few else wanted, "node")


def _rest_links(rest: DataFrame, links: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links between all members (band, k, node) of each bucket that links leave in different clusters."""
    placed = settled(texts.sparkSession, lambda: rest.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")), "placed_rest")
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("band").agg(F.sum("m").alias("n"), F.max(F.struct("m", "component")).alias("main"))
    sizes = save(sizes.filter("n > main.m").select("band", "n", "main"), "open")
    blocks = lambda x: F.ceil(x / CELL).cast("long")
    held = key_join(placed, sizes, "band", "n", placed.count()).withColumn("us", blocks(F.col("n") - F.col("main.m"))).withColumn("vs", blocks(F.col("n")))
    held = held.join(classes, "node").withColumn("by", F.xxhash64("node")).withColumn("free", F.expr("component <> main.component"))
    held = save(held, "held")
    cell = lambda rows, u, v, outer: rows.select("band", "k", u.alias("u"), v.alias("v"), F.lit(outer).alias("outer"), "free", "node", "component", "registers")
    every = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.col(x) - 1))
    at = lambda x: F.pmod("by", F.col(x))
    cells = cell(held.filter("free"), at("us"), every("vs"), True).unionByName(cell(held, every("us"), at("vs"), False))
    schema = "band long, k int, u long, v long, outer boolean, free boolean, node long, component long, registers binary"
    found = save(cells.groupBy("band", "u", "v").applyInPandas(_paired, schema), "found")
    sent = found.join(_picked(texts.withColumnRenamed("row", "node"), found), "node")
    return sent.groupBy("band", "u", "v").applyInPandas(_cell_links, "a long, b long, similarity double")


def _candidates(cell: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) of a cell's pairs across its sides whose registers agree and whose clusters differ, most alike first.

    A pair that shares several buckets is taken in the first, and two members outside the main cluster once.
    """
    outer, node, component = (cell[c].to_numpy() for c in ("outer", "node", "component"))
    u, v = np.flatnonzero(outer), np.flatnonzero(~outer)
    if not len(u) or not len(v):
        return u[:0], v[:0]
    x = np.frombuffer(b"".join(cell["registers"]), np.uint16).reshape(-1, REGISTERS).T
    agree, earlier = np.zeros((len(u), len(v)), np.uint8), np.zeros((len(u), len(v)), bool)
    for r in range(REGISTERS):
        same = x[r][u][:, None] == x[r][v]
        agree += same
        if r // ROWS < cell["k"].iloc[0]:
            band = same if r % ROWS == 0 else band & same
            if r % ROWS == ROWS - 1:
                earlier |= band
    twice = cell["free"].to_numpy()[v] & (node[u][:, None] > node[v])
    i, j = np.nonzero((agree >= ESTIMATE * REGISTERS) & ~earlier & ~twice & (component[u][:, None] != component[v]))
    order = np.argsort(-agree[i, j].astype(int), kind="stable")
    return u[i[order]], v[j[order]]


def _paired(cell: pd.DataFrame) -> pd.DataFrame:
    """The members of a cell that stand in a candidate pair."""
    i, j = _candidates(cell)
    return cell.iloc[np.unique(np.concatenate([i, j]))]


def _cell_links(cell: pd.DataFrame) -> pd.DataFrame:
    """Verified links that join clusters of one cell; pairs that those found so far connect need none."""
    sets = _sets(cell["text"])
    node, parent, out = cell["node"].to_numpy(), {c: c for c in cell["component"].tolist()}, []
    own = cell["component"].tolist()

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for i, j in zip(*(x.tolist() for x in _candidates(cell)), strict=True):
        a, b = root(own[i]), root(own[j])
        if a != b and (value := probability_jaccard(sets[i], sets[j])) >= SIMILARITY - 1e-12:
            parent[a] = b
            out.append((min(node[i], node[j]), max(node[i], node[j]), value))
    return pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": np.int64, "b": np.int64, "similarity": float})


def _sets(texts: pd.Series) -> list[tuple]:
    """(shingles, weights) of each text."""
    sets: list = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(texts)
    for own, h, counts in bytehash.word_hashes([t.encode("utf-8", "replace") for t in texts]):
        doc, key, weight = shingles(h, counts)
        cuts = np.searchsorted(doc, np.arange(len(own) + 1))
        for k, i in enumerate(own):
            sets[i] = key[cuts[k] : cuts[k + 1]], weight[cuts[k] : cuts[k + 1]]
    return sets


def _verify(texts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Verified links of one cell; each text is shingled once."""
    sets = dict(zip(texts["row"].tolist(), _sets(texts["text"]), strict=True))
    value = np.array([probability_jaccard(sets[a], sets[b]) for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True)], dtype=float)
    return pairs[["a", "b"]].assign(similarity=value)[value >= SIMILARITY - 1e-12]


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each cluster; all columns stay."""
    row = free_name(docs, "row")
    held = numbered(docs, row, codec=PACKED)
    rows = held.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(row).alias("row"))
    gone = settled(docs.sparkSession, lambda: bitmaps(_clusters(rows).filter(~F.col("kept")).select("row")), "gone")
    return marked(held, F.col(row), gone, keep=False).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Joins of names by a matching-blocks ratio or by containment, by bounds that lose no pair.

The ratio of a and b is 2M/T, T the sum of their lengths, M the characters in matching blocks. Three facts bound it:

- the blocks' characters are common to both, so they share at least t T / 2 characters, counted with repeats;
- between two blocks at least one character is unmatched, so of T - 2M unmatched characters follow at most
  T - 2M + 1 blocks, and a and b share at least M - (T - 2M + 1) >= (1.5 t - 1) T - 1 pairs of neighbouring characters;
- the blocks stand in one order in both, so M is at most the length of their longest common subsequence.

Such bounds leave no gram rare enough for an index: names of 20 characters that reach 0.82 need share only 7 of 19 pairs. So
names are taken distinct and dealt into blocks, each pair of blocks is one group, and in it every pair of names is
tested by one word of the bits of its commonest characters, what is left by the bits of all characters and of its pairs, then by
the subsequence (64 characters at once), then by the ratio. The work is still a few nanoseconds for each pair of distinct
names; memory is that of two blocks, which are shuffled, never broadcast.

A name inside a longer one has its rarest run of characters there: the shorter posts that one, the longer probes with all
of its own. Spark takes the size of rows that are exploded for that of the rows before, and would broadcast all runs of a table that
itself looks small; so joins of such rows are sort-merge joins by hint.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import top

#: Distinct names of a block, 64-bit words of a name's bits, elements of one pass of the subsequences, pairs tested at once, and most tasks.
BLOCK, WORDS, PASS, BATCH, TASKS = 1 << 14, 4, 1 << 22, 1 << 16, 1 << 12


def grams(name: Column, n: int) -> Column:
    """The distinct 'gram#k' of a name: its k-th occurrence of a run of n characters."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(n)))
    every = F.array_sort(F.filter(runs, lambda g: F.length(g) == n))
    return F.transform(every, lambda g, i: F.concat(g, F.lit("#"), (i + 2 - F.array_position(every, g)).cast("string")))


def _near(a: Column, b: Column, least: float) -> Column:
    """Whether lengths and common characters allow the ratio; nothing is lost by it."""
    total = F.length(a) + F.length(b)
    bound = least * total / 2 - 1e-9
    return (F.least(F.length(a), F.length(b)) >= bound) & (F.size(F.array_intersect(grams(a, 1), grams(b, 1))) >= bound)


def _occurrences(names: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, owner): a number for the k-th occurrence of each run of n characters (1 or 2) in each name, and the name's place."""
    size = [len(x) for x in names]
    code = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(names)), size)
    if n == 2:
        inside = owner[1:] == owner[:-1]
        code, owner = (code[:-1] << np.uint64(21) | code[1:])[inside], owner[1:][inside]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(code))
    k = at - np.maximum.accumulate(np.where(new, at, 0))
    return code * np.uint64(64) + k.astype(np.uint64) + np.uint64(1), owner


def gram_bits(names: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, lost) of each name: a bit for the k-th occurrence of each run of n characters (1 or 2), and how many fell on a bit in use.

    Two names share at most as many runs as they share bits, and those that either of them lost.
    """
    run, owner = _occurrences(names, n)
    h = run * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    wide = 64 * WORDS
    bits = np.zeros((len(names), wide), bool)
    bits[owner, (h >> np.uint64(40)).astype(np.int64) % (wide - 1)] = True  # the last one stays free, so a count fits in a byte
    return np.packbits(bits, axis=1).view(np.uint64), np.bincount(owner, minlength=len(names)) - bits.sum(axis=1)


def common_bits(names: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word, lost): one word of bits for each name and each of the others, and how many characters of each name have none.

    Bits stand for the 64 occurrences of characters that most of the others have. The bound of gram_bits holds for names.
    """
    there, there_owner = _occurrences(others, 1)
    every, count = np.unique(there, return_counts=True)
    known = np.sort(every[np.argsort(-count, kind="stable")[:64]])

    def words(run: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        bits = np.zeros((n, 64), bool)
        place = np.minimum(np.searchsorted(known, run), len(known) - 1)
        has = known[place] == run
        bits[owner[has], place[has]] = True
        return np.packbits(bits, axis=1).view(np.uint64)[:, 0]

    run, owner = _occurrences(names, 1)
    own = words(run, owner, len(names))
    return own, words(there, there_owner, len(others)), np.bincount(owner, minlength=len(names)) - np.bitwise_count(own)


def _padded(names: list[str], pad: int) -> np.ndarray:
    width = max(map(len, names))
    out = np.full((len(names), width), pad, np.int32)
    for i, x in enumerate(names):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair (a[i], b[i])."""
    x, y = _padded(a, -1), _padded(b, -2)
    row = np.zeros((len(a), y.shape[1] + 1), np.int32)
    for i in range(x.shape[1]):
        row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], row[:, :-1] + (y == x[:, i : i + 1])), axis=1)
    return row[:, -1]


def subsequence_bound(left: list[str], right: list[str]):
    """A function of places (i, j): at least the length of the longest common subsequence of left[i] and right[j], -1 if either is longer than 64.

    A name's places of a character are the bits of one word, and each character of the other moves all of them at once. Characters
    share 255 codes, so rare ones may count as equal.
    """
    size, there = (np.array([len(x) for x in names]) for names in (left, right))
    fits, width = (size <= 64), min(64, int(there.max(initial=0)))
    points = lambda names: np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = points([x for x in left if len(x) <= 64])
    letters = np.unique(own)[:254]
    coded = lambda c: np.where(letters[k := np.minimum(np.searchsorted(letters, c), len(letters) - 1)] == c, k, 254).astype(np.uint8)
    starts = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    places = np.zeros((len(left), 256), np.uint64)
    if len(own):
        n = size[fits]
        np.bitwise_or.at(places, (np.repeat(np.flatnonzero(fits), n), coded(own)), np.uint64(1) << starts(n).astype(np.uint64))
    short = there <= 64
    steps = np.full((width, len(right)), 255, np.uint8)  # no name has code 255
    if len(own) and short.any():
        n = there[short]
        steps[starts(n), np.repeat(np.flatnonzero(short), n)] = coded(points([x for x in right if len(x) <= 64]))

    def bound(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.full(len(i), -1)
        can = np.flatnonzero(fits[i] & short[j])
        can = can[np.argsort(-there[j[can]], kind="stable")]
        p, q = i[can], j[can]
        left_over = np.full(len(can), ~np.uint64(0))
        ends = np.searchsorted(-there[q], -np.arange(width), "left")  # names with more than s characters come first
        for s, n in enumerate(ends.tolist()):
            v = left_over[:n]
            u = v & places[p[:n], steps[s, q[:n]]]
            left_over[:n] = (v + u) | (v - u)
        out[can] = np.bitwise_count(~left_over)
        return out

    return bound


def likely(left: list[str], right: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs whose lengths, characters and pairs of neighbours allow the ratio; right is sorted by length."""
    word, column, rare = common_bits(left, right)
    (chars, lost), (own_chars, own_lost) = gram_bits(left, 1), gram_bits(right, 1)
    (pairs, pairs_lost), (own_pairs, own_pairs_lost) = gram_bits(left, 2), gram_bits(right, 2)
    length, sizes = (np.array([len(x) for x in names]) for names in (left, right))
    low = np.searchsorted(sizes, np.floor(length * least / (2 - least) - 1e-6)).tolist()
    high = np.searchsorted(sizes, np.ceil(length * (2 - least) / least + 1e-6), "right").tolist() if least > 0 else [len(sizes)] * len(left)
    needs: dict[tuple[int, int], np.ndarray] = {}

    def tested(found: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.repeat([p for p, _ in found], [len(q) for _, q in found]), np.concatenate([q for _, q in found])
        total = sizes[j] + length[i]
        shared = np.bitwise_count(own_chars[j] & chars[i]).sum(axis=1, dtype=np.int64) + np.minimum(lost[i], own_lost[j])
        keep = shared >= least * total / 2 - 1e-6
        i, j, total = i[keep], j[keep], total[keep]
        both = np.bitwise_count(own_pairs[j] & pairs[i]).sum(axis=1, dtype=np.int64) + np.minimum(pairs_lost[i], own_pairs_lost[j])
        keep = both >= (1.5 * least - 1) * total - 1 - 1e-6
        return i[keep], j[keep]

    wait: list[tuple[int, np.ndarray]] = []
    n = 0
    for i, key in enumerate(zip(length.tolist(), rare.tolist(), strict=True)):
        if key not in needs:
            if len(needs) == 256:
                needs.clear()
            needs[key] = np.clip(np.ceil(least * (sizes + key[0]) / 2 - 1e-6) - key[1], 0, 255).astype(np.uint8)
        within = slice(low[i], high[i])
        j = low[i] + np.flatnonzero(np.bitwise_count(column[within] & word[i]) >= needs[key][within])
        if len(j):
            wait.append((i, j))
            n += len(j)
        if n > BATCH:
            yield tested(wait)
            wait, n = [], 0
    if wait:
        yield tested(wait)


def _scored(least: float):
    """Pairs of two blocks of names with their ratio."""

    def by_subsequence(a: list[str], b: list[str]) -> Iterator[tuple[str, str]]:
        """Pairs of names, one of them of over 64 characters, in passes of bounded size."""
        order = sorted(range(len(a)), key=lambda k: len(b[k]))
        while order:
            n, widest = 0, 0
            while n < len(order) and (n == 0 or (n + 1) * max(widest, len(b[order[n]])) <= PASS):
                widest, n = max(widest, len(b[order[n]])), n + 1
            x, y = [a[k] for k in order[:n]], [b[k] for k in order[:n]]
            most = 2 * common_subsequence(x, y) / np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
            yield from ((x[k], y[k]) for k in np.flatnonzero(most >= least - 1e-9))
            order = order[n:]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str, float]] = []
        if len(a) and len(b):
            left, right = sorted(a["left"].iloc[0], key=len), sorted(b["right"].iloc[0], key=len)
            bound, size, there = subsequence_bound(left, right), np.array([len(x) for x in left]), np.array([len(x) for x in right])
            for i, j in likely(left, right, least):
                most = bound(i, j)
                fits, long = 2 * most >= least * (size[i] + there[j]) - 1e-6, most < 0
                near = [(left[p], right[q]) for p, q in zip(i[fits], j[fits], strict=True)]
                near += by_subsequence([left[p] for p in i[long]], [right[q] for q in j[long]])
                scores = ((x, y, SequenceMatcher(None, x, y).ratio()) for x, y in near if x != y)
                out += [s for s in scores if s[2] >= least]
        return pd.DataFrame(out, columns=["left_name", "right_name", "score"])

    return run


def _blocks(names: DataFrame, number: str, column: str) -> tuple[DataFrame, int]:
    """(number, column) with the distinct names of each of n blocks, and n."""
    own = names.select(F.col(names.columns[0]).alias("name")).filter("name <> ''").distinct()
    n = -(-own.count() // BLOCK) or 1
    dealt = own.select("name", F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias(number)).repartition(n, number)
    return dealt.groupBy(number).agg(F.collect_list("name").alias(column)), n


def ratio_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_name, right_name, score) of all pairs of a name of left and one of right with at least this ratio.

    left and right have one column of names; null and empty names meet nothing; equal names score 1. Each block is sent once for
    each block of the other side: both sides are shuffled by the pair of blocks, since a join might broadcast all copies of one.
    """
    (a, n_left), (b, n_right) = _blocks(left, "i", "left"), _blocks(right, "j", "right")
    tasks = min(3 * n_left * n_right - 2, TASKS)  # more tasks than groups, so that few tasks have several
    dealt = lambda df, number, n: df.withColumn(number, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(tasks, "i", "j").groupBy("i", "j")
    scored = dealt(a, "j", n_right).cogroup(dealt(b, "i", n_left)).applyInPandas(_scored(least), "left_name string, right_name string, score double")
    return scored.unionByName(_equal(left, right))


def _equal(left: DataFrame, right: DataFrame) -> DataFrame:
    name = lambda df: df.select(F.col(df.columns[0]).alias("name")).filter("name <> ''").distinct()
    return name(left).join(name(right).hint("merge"), "name", "left_semi").select(F.col("name").alias("left_name"), F.col("name").alias("right_name"), F.lit(1.0).alias("score"))


def _dealt(names: DataFrame, each: int = 1 << 16) -> DataFrame:
    """Distinct names dealt into tasks of about `each`, as many as there are cores at least: small partitions would be joined, then exploded."""
    return names.repartition(max(names.sparkSession.sparkContext.defaultParallelism, -(-names.count() // each)), *names.columns)


def _runs(name: Column, n: int) -> Column:
    """The distinct runs of n characters of a name."""
    return F.when(F.length(name) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substr(name, i, F.lit(n)))))


def _sharing_rarest(short: DataFrame, long: DataFrame, n: int) -> DataFrame:
    """(short_name, long_name) of all names of short and those of long that have its rarest run.

    A name of short posts the run of n characters that the fewest names of long have; one of fewer characters posts itself, and the
    names of long then probe with runs of that length too.
    """
    own = lambda df, c: df.select(F.col(df.columns[0]).alias(c)).filter(f"{c} <> ''").distinct()
    mine, theirs = own(short, "short_name"), own(long, "long_name")
    sizes = sorted({n} | {r[0] for r in mine.filter(F.length("short_name") < n).select(F.length("short_name")).distinct().collect()})
    probes = theirs.select("long_name", F.explode(F.flatten(F.array_compact(F.array(*[_runs(F.col("long_name"), k) for k in sizes])))).alias("run"))
    count = probes.filter(F.length("run") == n).groupBy("run").agg(F.count("*").alias("k"))
    runs = mine.select("short_name", F.explode(_runs(F.col("short_name"), n)).alias("run")).join(count.hint("merge"), "run", "left")
    rarest = runs.groupBy("short_name").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "run"))["run"].alias("run"))
    posted = rarest.unionByName(mine.filter(F.length("short_name") < n).withColumn("run", F.col("short_name")))
    return posted.hint("merge").join(probes, "run").select("short_name", "long_name")


def contained_pairs(short: DataFrame, long: DataFrame, n: int = 6) -> DataFrame:
    """(short_name, long_name): every name of short and the longer names of long that contain it."""
    return _sharing_rarest(short, long, n).filter((F.length("short_name") < F.length("long_name")) & F.contains("long_name", "short_name"))


def similar_organisations(probes: DataFrame, probe_id: str, known: DataFrame, known_id: str, name: str, key: str, least: float, floor: float, k: int, fuzzy: bool = True) -> DataFrame:
    """(probe_id, known_id, name, score): up to k known organisations that each probe resembles.

    key is the normalised name. Equal keys score 1, a key inside the other at least floor, others the ratio from least on
    (left out without fuzzy); scores have three places. Ties go to the lesser name, then id. Probes whose key is empty
    have no partner.
    """
    asked, there = _dealt(probes.select(key).distinct()), _dealt(known.select(key).distinct())
    inside = contained_pairs(asked, there).select(F.col("short_name").alias("a"), F.col("long_name").alias("b"))
    around = contained_pairs(there, asked).select(F.col("long_name").alias("a"), F.col("short_name").alias("b"))
    whole = F.least(F.length("a"), F.length("b")) * 2 / (F.length("a") + F.length("b"))  # the shorter is one block
    pairs = inside.unionByName(around).withColumn("score", F.greatest(F.lit(floor), whole))
    others = ratio_pairs(asked, there, least) if fuzzy else _equal(asked, there)
    pairs = pairs.unionByName(others.toDF("a", "b", "score")).groupBy("a", "b").agg(F.max("score").alias("score"))
    pairs = pairs.filter(F.col("score") >= least).withColumn("score", F.bround("score", 3))
    first = top(known.select(F.col(key).alias("b"), F.col(known_id), name), ["b"], [F.asc(name), F.asc(known_id)], k)  # no probe takes more of one key
    best = top(pairs.join(first.hint("merge"), "b"), ["a"], [F.desc("score"), F.asc(name), F.asc(known_id)], k)
    return probes.select(probe_id, F.col(key).alias("a")).join(best.hint("merge"), "a").select(probe_id, known_id, name, "score")


def nearest_known(names: DataFrame, key: str, known: DataFrame, brand: str, brand_key: str, least: float, apart: int = 3, short: int = 4) -> DataFrame:
    """(key, brand, score): the known brand nearest to each distinct key of at least four characters.

    Lengths differ by at most apart; keys of short characters also begin with the same two. Ties go to the lesser brand.
    """
    asked = names.select(key).filter(F.length(key) >= 4).distinct()
    pairs = ratio_pairs(asked, known.select(brand_key), least).toDF(key, brand_key, "score")
    close = (F.abs(F.length(key) - F.length(brand_key)) <= apart) & ((F.length(key) > short) | (F.substring(key, 1, 2) == F.substring(brand_key, 1, 2)))
    named = known.groupBy(brand_key).agg(F.min(brand).alias(brand))
    best = pairs.filter(close).join(named, brand_key).groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(brand).alias("b"))).alias("best"))
    return best.select(key, F.col("best.b").alias(brand), (-F.col("best.s")).alias("score"))


def lookup_known(names: DataFrame, name: str, key: Column, base: Column, known: DataFrame, brand: str, brand_key: str, least: float) -> DataFrame:
    """(name, brand, how) of distinct names: a brand of equal key, else of the key without a fire class, else the nearest."""
    own = names.select(name).distinct().select(name, key.alias("__key"), base.alias("__base"))
    named = known.groupBy(F.col(brand_key).alias("__k")).agg(F.min(brand).alias("__b"))
    hit = lambda df, c, to: df.join(named.select(F.col("__k").alias(c), F.col("__b").alias(to)), c, "left")
    exact = hit(hit(own, "__key", "__exact"), "__base", "__bare")
    fuzzy = nearest_known(exact.filter("__exact IS NULL AND __bare IS NULL"), "__key", known, brand, brand_key, least).select("__key", F.col(brand).alias("__near"))
    out = exact.join(fuzzy, "__key", "left")
    how = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__bare").isNotNull(), "base").when(F.col("__near").isNotNull(), "near")
    return out.select(name, F.coalesce("__exact", "__bare", "__near").alias(brand), how.alias("how"))


def snap_prefix(marks: DataFrame, prefix: str, known: DataFrame, brand: str, least: float) -> DataFrame:
    """(prefix, brand, score): the known brand of each prefix: one begins with the other, else the nearest by ratio.

    Both are compared in lower case. Ties go to the longer, then the lesser brand.
    """
    low = marks.select(F.lower(prefix).alias("p")).filter("p <> ''").distinct()
    brands = known.select(F.lower(brand).alias("k"), F.col(brand).alias("b")).filter(F.length("k") >= 2).groupBy("k").agg(F.min("b").alias("b"))
    starts = lambda df, c: df.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(F.col(c), F.lit(1), i))).alias("at"))
    begun = starts(low, "p").join(brands.select(F.col("k").alias("at"), "k").hint("merge"), "at").select("p", "k")
    begins = starts(brands, "k").join(low.select(F.col("p").alias("at"), "p").hint("merge"), "at").select("p", "k")
    whole = begun.union(begins).distinct().withColumn("score", F.lit(1.0))
    pairs = whole.unionByName(ratio_pairs(low, brands.select("k"), least).toDF("p", "k", "score")).join(brands, "k")
    best = pairs.groupBy("p").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.length("k")).alias("n"), F.col("b"))).alias("first"))
    return marks.select(prefix).distinct().withColumn("__p", F.lower(prefix)).join(best.withColumnRenamed("p", "__p"), "__p").select(prefix, F.col("first.b").alias(brand), (-F.col("first.s")).alias("score"))


def drop_contained(rows: DataFrame, group: str, name: str, least: int, exempt: Column | None = None, n: int = 4) -> DataFrame:
    """Distinct rows (group, name) without names that begin a longer name of their group, or stand inside one.

    Inside counts for names of at least `least` (not under n) characters. Exempt names stay, and nothing goes for their sake. Short names meet
    longer ones by an equi-join on beginnings of fewer than `least` characters; the others by their rarest run of n characters.
    """
    own = rows.select(F.col(group).alias("__g"), F.col(name).alias("name")).distinct().filter("name <> ''")
    own = own.withColumn("__exempt", F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False)))
    active = own.filter("NOT __exempt").drop("__exempt")
    ends = F.least(F.length("name") - 1, F.lit(least - 1))
    begins = active.filter(F.length("name") > 1).select("__g", F.explode(F.transform(F.sequence(F.lit(1), ends), lambda i: F.substr(F.col("name"), F.lit(1), i))).alias("name")).distinct()
    short = active.filter(F.length("name") < least).join(begins.hint("merge"), ["__g", "name"], "left_semi")
    runs = active.filter(F.length("name") >= least).select("__g", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substr(F.col("name"), i, F.lit(n))))).alias("run"))
    count = runs.groupBy("run").agg(F.count("*").alias("k"))
    rarest = runs.join(count.hint("merge"), "run").groupBy("__g", "name").agg(F.min(F.struct("k", "run"))["run"].alias("run"))
    longer = runs.withColumnRenamed("name", "other")
    inside = rarest.hint("merge").join(longer, ["__g", "run"]).filter((F.length("name") < F.length("other")) & F.contains("other", "name")).select("__g", "name")
    gone = short.unionByName(inside).distinct()
    return own.join(gone.hint("merge"), ["__g", "name"], "left_anti").select(F.col("__g").alias(group), F.col("name").alias(name))

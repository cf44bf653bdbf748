"""Matching free text to a catalogue: contained phrases, aliases, shared words, fuzzy names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import phrase, requirement, word_set

#: Rule tables are broadcast; they are written by hand and may not have more rows than this.
MAX_RULES = 10_000


def small(table: DataFrame, bound: int = MAX_RULES) -> DataFrame:
    """table, to be broadcast, after a check of its size."""
    if table.limit(bound + 1).count() > bound:
        raise ValueError(f"a rule table may have at most {bound} rows")
    return F.broadcast(table)


def lexicon(names: DataFrame, name: str) -> DataFrame:
    """One row, to be broadcast: a pattern of all names as whole words, in any case, longer ones before shorter ones."""
    known = small(names.filter(F.trim(name) != "").select(F.lower(F.trim(name)).alias("n")).distinct())
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("n")).alias("size"), F.concat(F.lit(r"\Q"), "n", F.lit(r"\E")).alias("quoted"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["quoted"]), "|")
    return F.broadcast(known.agg(F.concat(F.lit(r"(?iuU)\b("), joined, F.lit(r")\b")).alias("pattern")))


def contained_phrases(texts: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """Best confidence of every code any of whose patterns stands in the text: (key, code, confidence, pattern).

    The rule table goes to every task as one array and is looked through in the text's own row. Ties go to the
    longer, then the greater pattern.
    """
    table = small(patterns).agg(F.collect_list(F.struct("confidence", F.length("pattern").alias("size"), F.lower("pattern").alias("pattern"), "code")).alias("__rules"))
    own = texts.select(key, requirement(F.col(text)).alias("__text")).join(F.broadcast(table))
    hits = own.select(key, F.explode(F.filter("__rules", lambda r: F.contains("__text", r["pattern"]))).alias("r"))
    return hits.groupBy(key, "r.code").agg(F.max("r").alias("b")).select(key, "code", "b.confidence", "b.pattern")


def usage_confidence(usage: Column) -> Column:
    """Confidence of a learned mapping: 0.80 and 0.01 more for each use, at most 0.95."""
    return F.least(F.lit(0.95), 0.80 + F.least(F.coalesce(usage, F.lit(0)), F.lit(10)) * 0.01)


def combine_suggestions(key: str, synonyms: DataFrame, builtin: DataFrame, learned: DataFrame) -> DataFrame:
    """(key, code, confidence, source): built-in hits replace synonyms always, learned ones only if more confident."""
    s, b, n = (d.select(key, "code", F.col("confidence").alias(c)) for d, c in ((synonyms, "__s"), (builtin, "__b"), (learned, "__l")))
    every = s.join(b, [key, "code"], "full").join(n, [key, "code"], "full")
    base = F.coalesce("__b", "__s")
    use_learned = base.isNull() | (F.col("__l") > base)
    return every.select(key, "code", F.when(use_learned, F.coalesce("__l", base)).otherwise(base).alias("confidence"), F.when(F.col("__l").isNotNull() & use_learned, "learned").when(F.col("__b").isNotNull(), "builtin").otherwise("synonym").alias("source"))


def resolve_alias(phrases: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """The code of the alias equal to the phrase, else of one that contains it or is contained; least id wins."""
    table = small(aliases).select("alias_id", phrase(F.col("alias")).alias("a"), "code").agg(F.sort_array(F.collect_list(F.struct("alias_id", "a", "code"))).alias("__aliases"))
    own = phrases.select(key, phrase(F.col(text)).alias("__p")).join(F.broadcast(table))  # one row, looked through in the phrase's own
    p = F.col("__p")
    first = lambda keep: F.get(F.filter("__aliases", keep), F.lit(0))
    exact = first(lambda x: x["a"] == p)
    near = first(lambda x: (F.length(x["a"]) >= rules.ALIAS_CONTAINED_MIN) & (p != "") & (F.contains(p, x["a"]) | F.contains(x["a"], p)))
    hits = own.select(key, F.coalesce(exact, near).alias("b"), exact.isNotNull().alias("exact")).filter("b IS NOT NULL")
    best = F.min_by(F.struct("b.code", "exact"), F.struct(~F.col("exact"), "b.alias_id"))
    return hits.groupBy(key).agg(best.alias("x")).select(key, "x.code", "x.exact")


def shared_word_pairs(left: DataFrame, left_key: str, left_text: str, right: DataFrame, right_key: str, right_text: str) -> DataFrame:
    """(left, right, shared, score) of pairs that share a word, by an equi-join on words; score is their Jaccard."""
    a = left.select(left_key, word_set(F.col(left_text)).alias("__a"))
    b = right.select(right_key, word_set(F.col(right_text)).alias("__b"))
    wa = a.select(left_key, F.size("__a").alias("__na"), F.explode("__a").alias("__w"))
    wb = b.select(right_key, F.size("__b").alias("__nb"), F.explode("__b").alias("__w"))
    pairs = wa.join(wb, "__w").groupBy(left_key, right_key).agg(F.count("*").alias("shared"), F.first("__na").alias("__na"), F.first("__nb").alias("__nb"))
    return pairs.select(left_key, right_key, "shared", (F.col("shared") / (F.col("__na") + F.col("__nb") - F.col("shared"))).alias("score"))


def best_by_words(left: DataFrame, left_key: str, left_text: str, right: DataFrame, right_key: str, right_text: str) -> DataFrame:
    """The best partner of each left row: score at least JACCARD_MIN, two shared words or a score over JACCARD_ALONE."""
    pairs = shared_word_pairs(left, left_key, left_text, right, right_key, right_text)
    good = pairs.filter((F.col("score") >= rules.JACCARD_MIN) & ((F.col("shared") >= rules.SHARED_MIN) | (F.col("score") >= rules.JACCARD_ALONE)))
    return top(good, [left_key], [F.desc("score"), F.asc(right_key)])


def top(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key by a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio 2M/T of two strings; order-sensitive, unlike an edit distance."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(run, "double")(a, b)


def compact(name: Column) -> Column:
    """A designation without spaces, in capitals, with one sign for 'x'."""
    return F.translate(F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", "")), "×X", "ХХ")


def similarity_key(name: Column) -> Column:
    """A designation as it is compared: lower case, no spaces, х for × and x, е for ё."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", ""), "×xё", "ххе")


def brand_token(name: Column) -> Column:
    """The letters that begin a compact designation, up to its fire class; at most six."""
    start = F.regexp_extract(name, "^[А-ЯЁA-Z]{2,10}", 0)
    return F.substring(F.get(F.split(start, "НГ|NG|LS|HF|FR", 2), F.lit(0)), 1, 6)


def _brand_keys(token: Column) -> Column:
    """Keys of which compatible brands share one: the token; its first four letters; three, if either has no more."""
    n = F.length(token)
    three = F.concat(F.lit("3"), F.substring(token, 1, 3))
    keys = F.array(F.concat(F.lit("="), token), F.when(n >= 4, F.concat(F.lit("4"), F.substring(token, 1, 4))), F.when(n >= 3, three))
    return F.array_compact(keys)


def fuzzy_names(left: DataFrame, left_key: str, right: DataFrame, right_key: str, least: float, snap: float, k: int) -> DataFrame:
    """Up to k partners (left, right, score, snapped) of each left designation among those of compatible brands.

    Brands are compatible if equal or alike in their first three or four letters (three only if one has no more); a
    designation without a brand may meet any other. The score is the matching-blocks ratio of the compact forms; ties
    go to the shorter, then the lesser partner. The best one is snapped to from the score snap on. Both sides are
    taken distinct. Branded designations meet by the beginnings of their brands, all others through
    similar.ratio_pairs; lengths and common characters that rule out the score are tested before the ratio.
    """
    from .similar import _near, ratio_pairs

    def named(df: DataFrame, key: str, side: str) -> DataFrame:
        return df.select(F.trim(key).alias(key)).filter(F.col(key) != "").distinct().withColumn(side, similarity_key(F.col(key))).withColumn(f"{side}_t", brand_token(compact(F.col(key))))

    a, b = named(left, left_key, "__a"), named(right, right_key, "__b")
    keyed = lambda df, side: df.filter(F.col(f"{side}_t") != "").withColumn("__key", F.explode(_brand_keys(F.col(f"{side}_t"))))
    long_enough = ~F.startswith("__key", F.lit("3")) | (F.least(F.length("__a_t"), F.length("__b_t")) == 3)
    near = keyed(a, "__a").join(keyed(b, "__b"), "__key").filter(long_enough).select(left_key, right_key, "__a", "__b").distinct()
    near = near.filter((F.col("__a") == F.col("__b")) | _near(F.col("__a"), F.col("__b"), least))
    branded = near.withColumn("score", F.when(F.col("__a") == F.col("__b"), 1.0).otherwise(ratio(F.col("__a"), F.col("__b"))))

    def any_brand(x: DataFrame, y: DataFrame) -> DataFrame:
        found = ratio_pairs(x.select("__a"), y.select("__b"), least).toDF("__a", "__b", "score")
        return x.select(left_key, "__a").join(found, "__a").join(y.select(right_key, "__b"), "__b").select(left_key, right_key, "score")

    others = any_brand(a.filter("__a_t = ''"), b).unionByName(any_brand(a.filter("__a_t <> ''"), b.filter("__b_t = ''")))
    scored = branded.select(left_key, right_key, "score").unionByName(others).withColumn("score", F.round("score", 6)).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy(left_key).orderBy(F.desc("score"), F.length(right_key), right_key))
    ranked = scored.withColumn("__rank", rank).filter(F.col("__rank") <= k)
    return ranked.select(left_key, right_key, "score", ((F.col("__rank") == 1) & (F.col("score") >= snap)).alias("snapped"))


def longest_prefix(marks: DataFrame, key: str, mark: str, known: DataFrame, brand: str) -> DataFrame:
    """(key, brand) of the longest known brand that begins a mark, by an equi-join on every beginning of the mark."""
    starts = marks.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length(mark)), lambda n: F.substr(F.col(mark), F.lit(1), n))).alias(brand))
    hits = starts.join(known.select(brand).distinct(), brand)
    return hits.groupBy(key).agg(F.max_by(brand, F.length(brand)).alias(brand))


def cascade(items: DataFrame, key: str, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """The code and score of the first stage that has one, and its name; stages are tables (key, code, score)."""
    out = items.select(key)
    for name, table in stages:
        out = out.join(table.select(key, F.struct("code", F.col("score").cast("double").alias("score"), F.lit(name).alias("method")).alias(f"__{name}")), key, "left")
    hit = F.coalesce(*[F.col(f"__{name}") for name, _ in stages])
    return out.select(key, hit["code"].alias("code"), hit["score"].alias("score"), hit["method"].alias("method"))

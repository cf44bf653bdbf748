"""Candidates mined from texts for review: what rules find, with bounded examples, and phrases that many documents share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def examples(rows: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """(keys, examples): the k items of each key whose hashes are least, an even sample that does not depend on the data's order.

    Each task keeps k rows of a key before anything is shuffled (the limit by rank is pushed below the exchange).
    """
    own = rows.select(*keys, item).distinct().withColumn("__h", F.md5(F.concat_ws("|", *keys, F.col(item).cast("string"))))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", item))
    first = own.withColumn("__rank", rank).filter(F.col("__rank") <= k)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", item))), lambda x: x[item]).alias("examples"))


def candidates(docs: DataFrame, key: str, text: str, patterns: dict[str, str], least: int, noise: str, k: int) -> DataFrame:
    """(kind, candidate, n_docs, n_places, examples) of everything that the patterns find, lower-cased and squeezed.

    Candidates of fewer than least characters, or that match noise, are left out; examples are up to k keys of documents.
    """

    def of(kind: str, pattern: str) -> Column:
        each = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), 0)
        return F.transform(each, lambda c: F.struct(F.lit(kind).alias("kind"), F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))).alias("candidate")))

    found = F.concat(*[of(kind, p) for kind, p in patterns.items()])
    rows = docs.select(key, F.explode(found).alias("c")).select(key, "c.kind", "c.candidate").filter((F.length("candidate") >= least) & ~F.rlike("candidate", F.lit(noise)))
    by_doc = rows.groupBy("kind", "candidate", key).agg(F.count("*").alias("n"))
    counts = by_doc.groupBy("kind", "candidate").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_places"))
    return counts.join(examples(by_doc, ["kind", "candidate"], key, k), ["kind", "candidate"])


def frequent_phrases(docs: DataFrame, key: str, words: Column, support: int, longest: int, save: Callable[[DataFrame], DataFrame], shortest: int = 1) -> DataFrame:
    """(phrase, n_words, support) of runs of `shortest` to `longest` words that at least `support` documents have.

    The distinct runs of a row are listed in the row and counted in each task before they are shuffled. Rows that share a key
    are one document, also those with a null key; only their runs are taken distinct together.
    """
    own = docs.select(F.col(key).alias("__key"), words.alias("__words"))
    again = save(own.groupBy("__key").count().filter("count > 1").select(F.col("__key").alias("__again"), F.lit(True).alias("__many")))
    own = own.join(again, F.col("__key").eqNullSafe(F.col("__again")), "left").drop("__again")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("__words") - n + 1)
        every = F.filter(F.transform(starts, lambda i: F.slice("__words", i, n)), lambda w: ~F.array_contains(w, ""))
        return F.when(F.size("__words") >= n, F.transform(F.array_distinct(every), lambda w: F.struct(F.array_join(w, " ").alias("phrase"), F.lit(n).alias("n_words"))))

    listed = own.select("__key", "__many", F.explode(F.flatten(F.array_compact(F.array(*[runs(n) for n in range(shortest, longest + 1)])))).alias("r")).select("__key", "__many", "r.*")
    single = listed.filter("__many IS NULL").select("phrase", "n_words")
    shared = listed.filter("__many").select("__key", "phrase", "n_words").distinct().select("phrase", "n_words")
    return single.unionByName(shared).groupBy("phrase", "n_words").agg(F.count("*").alias("support")).filter(F.col("support") >= support)


def review_queue(phrases: DataFrame, rule: Column) -> DataFrame:
    """phrases with status: promoted where a rule gives a code, else needs_review."""
    return phrases.withColumn("code", rule).withColumn("status", F.when(F.col("code").isNotNull(), "promoted").otherwise("needs_review"))

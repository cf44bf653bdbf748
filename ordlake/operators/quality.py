"""Measures of extraction quality: precision and recall, match rates, snapshot scores and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules


def precision_recall(expected: DataFrame, predicted: DataFrame, key: str, item: str) -> DataFrame:
    """Per key: raw and distinct expected, distinct predicted, matched, precision, recall (null without a base)."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = expected.select(key, item, one.alias("e"), none.alias("p")).unionByName(predicted.select(key, item, none.alias("e"), one.alias("p")))
    items = rows.groupBy(key, item).agg(F.sum("e").alias("n_raw"), F.max("e").alias("e"), F.max("p").alias("p"))  # repeats end here, in each task first
    n = lambda x: F.coalesce(F.sum(F.when(F.col(item).isNotNull(), x)), none)
    out = items.groupBy(key).agg(F.sum("n_raw").alias("n_raw"), n(F.col("e")).alias("n_expected"), n(F.col("p")).alias("n_predicted"), n(F.col("e") * F.col("p")).alias("n_matched"))
    share = lambda n: F.when(F.col(n) > 0, F.col("n_matched") / F.col(n))
    return out.withColumn("precision", share("n_predicted")).withColumn("recall", share("n_expected"))


def overall_recall(per_key: DataFrame) -> DataFrame:
    """Macro recall, and micro recall over the raw expected lists, repeats included."""
    return per_key.agg(F.count("*").alias("n_keys"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.sum("n_matched") / F.sum("n_raw"), 6).alias("micro_recall"))


def snapshot_score(chars: Column, marks: Column, with_document: Column, customer: Column, manufacturer: Column, organisations: Column, tables: Column, garbled: Column) -> Column:
    """Capped sum of what an extraction found; at most 0.85 while known OCR garbage is in it."""
    part = lambda each, n, cap: F.least(F.lit(cap), each * n)
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    total = flag(chars > 100, 0.2) + flag(chars > 1000, 0.1) + part(0.05, marks, 0.35) + part(0.03, with_document, 0.15) + flag(customer, 0.1) + flag(manufacturer, 0.05) + part(0.03, organisations, 0.1) + flag(tables > 0, 0.05)
    return F.round(F.least(F.when(garbled, F.least(total, F.lit(0.85))).otherwise(total), F.lit(1.0)).cast("decimal(12,6)"), 3).cast("double")


def compare(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """Per key: sizes, common and one-sided items, Jaccard (1 if both are empty) and both recalls."""
    own = a.select(key, item).distinct().withColumn("__a", F.lit(1)).join(b.select(key, item).distinct().withColumn("__b", F.lit(1)), [key, item], "full")
    n = lambda c: F.sum(c).cast("long")
    has_a, has_b = F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0))
    out = own.groupBy(key).agg(n(has_a).alias("n_a"), n(has_b).alias("n_b"), n(has_a * has_b).alias("n_both"), n(has_a * (1 - has_b)).alias("only_a"), n(has_b * (1 - has_a)).alias("only_b"))
    share = lambda x, y: F.when(y > 0, F.round(x / y, 4))
    both = F.col("n_both")
    return out.withColumn("jaccard", F.coalesce(share(both, F.col("n_a") + F.col("n_b") - both), F.lit(1.0))).withColumn("recall_a_vs_b", share(both, F.col("n_b"))).withColumn("recall_b_vs_a", share(both, F.col("n_a")))


def winner(a: Column, b: Column) -> Column:
    return F.when(b > a + rules.QUALITY_MARGIN, "B").when(a > b + rules.QUALITY_MARGIN, "A").otherwise("tie")


def compare_runs(a: DataFrame, b: DataFrame, key: str, measures: list[str], score: str) -> DataFrame:
    """Per key of either run: differences of measures (b less a, null where a run lacks the key) and the winner by score."""
    own = lambda df, side: df.select(key, *[F.col(c).alias(f"{side}_{c}") for c in [*measures, score]])
    both = own(a, "a").join(own(b, "b"), key, "full")
    deltas = [(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"delta_{c}") for c in measures]
    x, y = F.col(f"a_{score}"), F.col(f"b_{score}")
    return both.select(key, *deltas, F.round(y - x, 3).alias(f"delta_{score}"), F.when(x.isNotNull() & y.isNotNull(), winner(x, y)).alias("winner"))


def batch(df: DataFrame, keys: list[str], error: Column, before: Column, after: Column, sure_before: Column, sure_after: Column) -> DataFrame:
    """Files of a batch: all, done, failed, and improved: a smaller error rate after, or, where there is none, more confidence."""
    better = F.coalesce(after < before, F.coalesce(sure_after, F.lit(0.0)) > F.coalesce(sure_before, F.lit(0.0)))
    return df.groupBy(*keys).agg(F.count("*").alias("files_total"), F.count_if(~error).cast("long").alias("files_ok"), F.count_if(error).cast("long").alias("files_error"), F.count_if(~error & better).cast("long").alias("improved"))


def match_rate(df: DataFrame, matched: Column, keys: list[str]) -> DataFrame:
    """Matched and all rows, the rate and its text."""
    out = df.groupBy(*keys).agg(F.count_if(matched).cast("long").alias("n_matched"), F.count("*").alias("n_total"))
    return out.withColumn("rate", F.round(F.col("n_matched") / F.col("n_total"), 4)).withColumn("summary", F.format_string("сопоставлено %d/%d (%.0f%%)", "n_matched", "n_total", 100 * F.col("n_matched") / F.col("n_total")))

"""First-per-key, latest version, merging of lists, dropping contained rows, repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).filter("__n = 1").drop("__n")


def versions(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """label_version counts up within the key, is_active marks the last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("label_version", F.row_number().over(w).cast("long")).withColumn("is_active", F.col("label_version") == last)


def richer(df: DataFrame, key: str, text: str, ordinal: str, fill: list[str]) -> DataFrame:
    """Rows of a key merged: the longest text (first on ties), and the first non-null value of each other column."""
    order = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ordinal)))
    return df.groupBy(key).agg(F.max_by(text, F.struct(F.length(text), -F.col(ordinal))).alias(text), *[order(c).alias(c) for c in fill])


def drop_prefixes(df: DataFrame, group: str, name: str) -> DataFrame:
    """Distinct names of a group without those that are a prefix of a longer name of the group.

    In the order of names every name that has prefix p follows p at once, so looking at the next name is enough.
    """
    names = df.select(group, name).distinct()
    after = F.lead(name).over(Window.partitionBy(group).orderBy(name))
    return names.withColumn("__next", after).filter(F.col("__next").isNull() | ~F.startswith(F.col("__next"), F.col(name))).drop("__next")


def unique_lines(df: DataFrame, key: str, text: str, cap: int) -> DataFrame:
    """Lines of each text without later copies, in order, as long as their sizes (with line ends) sum to at most cap."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    lines = lines.groupBy(key, "line").agg(F.min("pos").alias("pos"))
    size = F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("pos"))
    kept = lines.withColumn("__size", size).filter(F.col("__size") <= cap)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("compact"), F.count("*").alias("n_lines"))


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest non-null value of each key; the least value on ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max("n").alias("n"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def fill_gaps(df: DataFrame, key: str, value: str, empty: Column | None = None) -> DataFrame:
    """df with missing values (null, or where empty holds) replaced by the most frequent value of the key, if it has one."""
    known = F.col(value) if empty is None else F.when(~F.coalesce(empty, F.lit(False)), F.col(value))
    own = df.withColumn("__known", known)
    best = most_frequent(own, key, "__known").select(F.col(key).alias("__key"), F.col("__known").alias("__best"))
    filled = own.join(best, F.col(key) == F.col("__key"), "left")
    return filled.select(*[F.coalesce("__known", "__best").alias(value) if c == value else F.col(c) for c in df.columns])


def move_to_front(items: Column, item: Column, k: int = 5) -> Column:
    """An array with item first and not repeated, at most k long."""
    return F.slice(F.concat(F.array(item), F.array_remove(items, item)), 1, k)

"""Reads over documents, orders and organisations: searches, details, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze


def all_of(predicates: list[Column]) -> Column:
    """Conjunction; true if there are none."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def search(df: DataFrame, columns: list[str], needle: str | None = None, order: list[Column] | None = None, limit: int | None = None, **equal) -> DataFrame:
    """Rows with needle in any of the columns (nulls as empty) and the given equal values; order must be total."""
    tests = [F.col(k) == v for k, v in equal.items() if v is not None]
    if needle:
        tests.append(reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower())) for c in columns]))
    out = df.filter(all_of(tests))
    out = out.orderBy(*order) if order else out
    return out.limit(limit) if limit else out


def token_search(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows whose joined columns hold every word of needle."""
    blob = F.lower(squeeze(F.concat_ws(" ", *columns)))
    return df.filter(all_of([F.contains(blob, F.lit(w)) for w in needle.lower().split()]))


def with_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """parents with the number of their children, 0 included."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def with_dimension(facts: DataFrame, dimension: DataFrame, key: str, dimension_key: str, columns: dict[str, str], how: str = "left") -> DataFrame:
    """facts with columns of a dimension under new names."""
    own = dimension.select(F.col(dimension_key).alias(key), *[F.col(c).alias(n) for c, n in columns.items()])
    return facts.join(own, key, how)


def nested(children: DataFrame, key: str, order: list[str], columns: list[str], name: str) -> DataFrame:
    """Children of each key as an array of structs in order."""
    own = list(dict.fromkeys([*order, *columns]))
    return children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name))


def in_use(keys: DataFrame, key: str, users: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """For every key how many rows of each table refer to it, and whether it may be deleted."""
    out = keys.select(key)
    for name, (table, column) in users.items():
        out = with_counts(out, table, key, column, name)
    return out.withColumn("deletable", all_of([F.col(n) == 0 for n in users]))

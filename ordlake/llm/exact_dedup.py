"""Operator 4: exact deduplication by two passes over a Bloom filter.

Pass one inserts every text hash in a filter that saturates at two; the bits seen at least twice are merged over
all tasks. Pass two asks that filter for each row: only rows whose hash possibly repeats are shuffled, all others
pass straight through. A false positive merely shuffles a row; no repeated text can be missed.

Defined results: a null text counts as the empty one; empty texts equal each other; the largest doc_id of a group
stays and null is the smallest; of repeated rows (same doc_id and text) exactly one stays; an empty table gives an
empty result; other columns are carried along and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import possibly_in, seen_filter
from .common import key_join, save


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = save(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(_text(text_col), 256)).alias("sha"), F.monotonically_increasing_id().alias("row")).withColumn("h", F.xxhash64("sha")), "hashes")
    n = rows.count()
    test = possibly_in(rows.sparkSession, seen_filter(rows.select("h"), n, 2))
    rows = rows.withColumn("again", test("h"))
    again = save(rows.filter("again"), "again")
    best = F.max(F.struct(F.col("doc_id"), F.col("row")))
    groups = save(again.groupBy("sha").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    judged = key_join(again, groups, "sha", "group_size", n)
    out = lambda df, keep, size, kept: df.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    alone = out(rows.filter("not again"), F.col("doc_id"), F.lit(1), F.lit(True))
    return alone.unionByName(out(judged, F.col("best.doc_id"), F.col("group_size"), F.col("row") == F.col("best.row")))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates() drops; all columns stay.

    Only possibly repeated rows are shuffled, after a partial aggregation in each task.
    """
    hashes = docs.select(F.xxhash64(_text(text_col)).alias("h"))
    bits = seen_filter(hashes, docs.count(), 2)
    test = possibly_in(docs.sparkSession, bits)
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _text(text_col).alias("text"), F.col(id_col).alias("id"), test(F.xxhash64(_text(text_col))).alias("again"))
    best = tagged.filter("again").groupBy(F.sha2("text", 256).alias("sha")).agg(F.max_by("doc", F.struct("id")).alias("doc"))
    return tagged.filter("not again").select("doc.*").unionByName(best.select("doc.*"))

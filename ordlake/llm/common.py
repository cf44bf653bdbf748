"""Shared pieces of the training-data operators: scratch tables, row keys, skew-safe joins."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder

#: Groups that hold at least this share of all rows are joined by broadcast, so at most 1/HOT_SHARE of them exist.
HOT_SHARE = 1 / 2000
#: Rows of one long that may be broadcast: 16 MB or so.
BROADCAST_ROWS = 1 << 20
#: Spark's setting of the rows in an Arrow batch, and how many texts one may hold where memory is short.
ARROW_ROWS, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: How written tables with texts are compressed.
PACKED = "zstd"

_scopes = threading.local()  # folders that save() has written, for each open passing() of this thread


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column, called free_name(df, name); no column of df is replaced."""
    return df.withColumn(free_name(df, name), value)


def _open_scopes() -> list[list[str]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


def _new_folder(spark: SparkSession) -> str:
    at = folder(spark)
    for own in _open_scopes()[-1:]:
        own.append(at)
    return at


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What save() writes inside is deleted at the end: for steps that end in values or in a written table."""
    scopes = _open_scopes()
    scopes.append([])
    try:
        yield
    finally:
        for x in scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(x)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def transient(step: Callable) -> Callable:
    """A step from a table to values; what it writes on the way is deleted at its end."""

    @wraps(step)
    def run(df: DataFrame, *args, **kw):
        with passing(df.sparkSession):
            return step(df, *args, **kw)

    return run


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str = "t", **how) -> DataFrame:
    """save(make()); what make() has written on the way is deleted then, as only the written result is read later."""
    at = _new_folder(spark)
    with passing(spark):
        return _written(make(), f"{at}/{name}", **how)


def save(df: DataFrame, name: str = "t", **how) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors; how is that of _written()."""
    return _written(df, f"{_new_folder(df.sparkSession)}/{name}", **how)


def _written(df: DataFrame, path: str, batch: int | None = None, codec: str | None = None) -> DataFrame:
    """df written to path and read back.

    batch is the most rows that Arrow functions get at a time in this write, where rows hold texts: a batch is held
    several times over, by the task and by its Python worker. The session's own setting is back when the write ends.
    codec compresses the files; without it the session's setting does.
    """
    spark = df.sparkSession
    had = spark.conf.get(ARROW_ROWS)
    try:
        if batch and not 0 < int(had) <= batch:
            spark.conf.set(ARROW_ROWS, batch)
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, had)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str, **how) -> DataFrame:
    """docs with a number of each row in the column name, written: so texts and numbers agree in every later read,
    whatever the table's splits are after an executor was lost."""
    return save(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", **how)


def key_join(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """Join rows to one row per key, where a few keys may own a large share of all rows.

    Keys with at least n_rows * HOT_SHARE rows number at most 1/HOT_SHARE: their hashes are looked up in each row and
    their groups broadcast; every other key is small enough for a shuffle. Nothing is dropped: with how='left'
    unmatched rows get nulls.
    """
    limit = max(64, int(n_rows * HOT_SHARE))
    hot = [r.h for r in groups.filter(F.col(size) >= limit).select(F.xxhash64(key).alias("h")).distinct().collect()]
    if not hot:
        return rows.join(groups, key, how)
    is_hot = F.xxhash64(key).isin(hot)
    first = rows.filter(is_hot).join(F.broadcast(groups.filter(is_hot)), key, how)
    return first.unionByName(rows.filter(~is_hot).join(groups.filter(~is_hot), key, how))


def small_join(rows: DataFrame, side: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined to a written table of single keys; it is broadcast if it has at most BROADCAST_ROWS rows.

    So wide rows are shuffled only where the keys are too many to be sent to every task.
    """
    few = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(side) if few else side, key, how)


def bitmaps(numbers: DataFrame) -> DataFrame:
    """The numbers in the only column of a table, as one bitmap of 4 KB for each 32,768 successive ones that has any.

    numbered() counts within each task, so this is about an eighth of a byte for each row and 4 KB for each task.
    """
    x = numbers.columns[0]
    dealt = numbers.select(F.bitmap_bucket_number(x).alias("bucket"), F.bitmap_bit_position(x).alias("at")).repartition("bucket")
    return dealt.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def marked(rows: DataFrame, number: Column, bits: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose number is in written bitmaps() (keep=False: is not); they are broadcast, so no row is shuffled."""
    at, bucket, held = free_name(rows, "at"), free_name(rows, "bucket"), free_name(rows, "bits")
    sent = F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(held)))
    found = rows.withColumn(at, F.bitmap_bit_position(number)).withColumn(bucket, F.bitmap_bucket_number(number)).join(sent, bucket, "inner" if keep else "left")
    byte = f"cast(conv(hex(substring(`{held}`, cast(`{at}` div 8 as int) + 1, 1)), 16, 10) as bigint)"
    is_set = F.coalesce(F.expr(f"getbit({byte}, cast(`{at}` % 8 as int)) = 1"), F.lit(False))
    return found.filter(is_set if keep else ~is_set).select(*[F.col(f"`{c}`") for c in rows.columns])


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of edges (a, b): component is one of the nodes; nodes are longs.

    Each round merges every node with the neighbour (or itself) that has the least hash, and only edges between
    merged nodes remain, so stars vanish in a round or two and paths shrink by a constant factor. Each round is a
    written table; neighbours are reduced in each task before they are shuffled, and hubs are joined as hot keys.
    """
    edges = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    merged: list[DataFrame] = []
    while True:
        by = lambda c, k=len(merged): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("to"))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        near = both.groupBy("node").agg(F.min(by("other")).alias("best"), F.count("*").alias("degree"))
        merged.append(save(near.select("node", F.least(by("node"), "best")["to"].alias("parent"), "degree"), "merged"))
        n = edges.count()
        if not n:
            break
        end = lambda c: merged[-1].select(F.col("node").alias(c), F.col("parent").alias(f"p_{c}"), "degree")
        half = key_join(edges, end("a"), "a", "degree", n).select("b", "p_a")
        kept = key_join(half, end("b"), "b", "degree", n).filter("p_a <> p_b")
        edges = save(kept.select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b")).distinct(), "edges")
    out = merged.pop().select("node", F.col("parent").alias("root"))  # no rows
    for labels in reversed(merged):
        of = labels.groupBy("parent").agg(F.count("*").alias("size")).join(out.withColumnRenamed("node", "parent"), "parent", "left")
        known = of.select("parent", "size", F.coalesce("root", "parent").alias("root"))
        out = save(key_join(labels.select("node", "parent"), known, "parent", "size", labels.count()).select("node", "root"), "labels")
    return out.select("node", F.col("root").alias("component"))

"""Folders that are tailed into tables exactly once: each batch is data first, then one entry in a ledger that makes it count.

A batch writes its rows to a folder of its own and afterwards one ledger file, which names that folder, the batch's number and the
content hash of every input file. What a killed run has written without its entry is never read; when the batch comes
again it finds no entry and is done anew, and if it finds one it is skipped. A file whose content an earlier batch has had, under any
name, adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import files

_ENTRY = "batch long, folder string, file string, n long, h long"


def entries(spark: SparkSession, table: str) -> DataFrame:
    """The ledger: one row for each input file of every batch that counts (file is null if a batch had nothing new)."""
    marker = spark.createDataFrame([(-1, None, None, None, None)], _ENTRY)
    marker.limit(0).write.mode("append").parquet(f"{table}/ledger")  # the folder exists
    return spark.read.schema(_ENTRY).parquet(f"{table}/ledger")


def commit(spark: SparkSession, table: str, batch: int, folder: str, fresh: DataFrame) -> None:
    """The entry of a batch, as one file: it is there or it is not."""
    none = spark.createDataFrame([(None, None, None)], "file string, n long, h long")
    rows = fresh.select("file", "n", "h").unionByName(none).select(F.lit(batch).cast("long").alias("batch"), F.lit(folder).alias("folder"), "file", "n", "h")
    rows.coalesce(1).write.mode("append").parquet(f"{table}/ledger")


def fresh_files(batch: DataFrame, known: DataFrame, content: list[str]) -> DataFrame:
    """(file, n, h) of the batch's files with contents that neither the ledger nor a lesser file of the batch has."""
    whole = batch.groupBy("file").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*content)).alias("h"))
    first = whole.groupBy("n", "h").agg(F.min("file").alias("file"))
    return first.join(known.filter("file IS NOT NULL").select("n", "h").distinct(), ["n", "h"], "left_anti")


def tail_json(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str, values: list[str], table: str, state: str) -> None:
    """Merge what is new below path (JSON lines) into a table: per key the values of the row that is greatest by order.

    Rows stay apart by batch; current() puts them together. Equal rows in one file count once for the hash of their
    contents if they come an even number of times, so files are told apart by their number of rows as well.
    """
    columns = [f.name for f in schema]

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = entries(session, table)
        if known.filter(F.col("batch") == number).limit(1).count():
            return
        fresh = fresh_files(batch, known, columns)
        rows = batch.join(fresh.select("file"), "file", "left_semi")
        delta = rows.groupBy(*keys).agg(F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values])
        folder = f"{table}/data/{number}-{uuid.uuid4().hex}"
        delta.write.parquet(folder)
        commit(session, table, number, folder, fresh)

    source = spark.readStream.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    source.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, table: str, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """The merged table of the batches that count; key and order columns are all but the last ones of a batch by default."""
    folders = [r.folder for r in entries(spark, table).filter("folder IS NOT NULL").select("folder").distinct().collect()]  # one a batch
    rows = spark.read.parquet(*folders)
    order = order or rows.columns[next(i for i, c in enumerate(rows.columns) if c not in (keys or rows.columns[:3]))]
    keys = keys or rows.columns[: rows.columns.index(order)]
    values = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values])


def ingest(spark: SparkSession, inbox: str, table: str, state: str) -> dict[str, int]:
    """Register the files that are new in a folder tree: (sha256, kind, path, size, text) by content, once for equal ones.

    Files of unknown kinds go to a quarantine of paths. Returns what this run registered, knew already, and set apart.
    """
    done = {"registered": 0, "known": 0, "quarantined": 0}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        ledger = entries(session, table)
        if ledger.filter(F.col("batch") == number).limit(1).count():
            return
        rows = files.described(batch)
        good = rows.filter("kind IS NOT NULL")
        first = good.groupBy("sha256").agg(F.min("path").alias("path"))
        old = registered(session, table)
        new = first if old is None else first.join(old.select("sha256"), "sha256", "left_anti")
        folder = f"{table}/data/{number}-{uuid.uuid4().hex}"
        text = F.when(F.col("kind").isin("text", "json"), F.col("content").cast("string"))
        good.join(new, ["sha256", "path"]).select("sha256", "kind", "path", "size", text.alias("text")).write.parquet(f"{folder}/files")
        rows.filter("kind IS NULL").select("path", "size").write.parquet(f"{folder}/quarantine")
        commit(session, table, number, folder, session.createDataFrame([], "file string, n long, h long"))
        n = session.read.parquet(f"{folder}/files").count()
        q = session.read.parquet(f"{folder}/quarantine").count()
        done["registered"] += n
        done["quarantined"] += q
        done["known"] += rows.count() - n - q

    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(inbox)
    source.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return done


def registered(spark: SparkSession, table: str, part: str = "files") -> DataFrame | None:
    """Files registered (or quarantined) by the batches that count; None before the first."""
    folders = [f"{r.folder}/{part}" for r in entries(spark, table).filter("folder IS NOT NULL").select("folder").distinct().collect()]
    return spark.read.parquet(*folders) if folders else None

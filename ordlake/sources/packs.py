"""Data packs that move rows between stores by high-water marks and content hashes, and imports that are checked row by row."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "table string, n_rows long, since timestamp, until timestamp, columns string"


def export_pack(tables: dict[str, DataFrame], time: str, root: str, name: str, since: dict[str, datetime] | None) -> dict[str, datetime]:
    """Write a pack of every table's rows after its high-water mark, and a manifest; returns the new marks.

    Rows without a time are never exported. A table without new rows keeps its mark. The manifest comes last, so a pack
    without one is unfinished.
    """
    marks, manifest = dict(since or {}), []
    spark = None
    for table, df in tables.items():
        spark = df.sparkSession
        own = df.filter(F.col(time).isNotNull())
        if table in marks:
            own = own.filter(F.col(time) > F.lit(marks[table]))
        seen = Observation()
        own.observe(seen, F.count("*").alias("n"), F.max(time).alias("until")).write.mode("overwrite").json(f"{root}/{name}/{table}")
        before = marks.get(table)
        if seen.get["n"]:
            marks[table] = seen.get["until"]
        manifest.append((table, seen.get["n"], before, marks.get(table), own.schema.json()))
    if spark:
        spark.createDataFrame(manifest, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/{name}/manifest")
    return marks


def import_pack(spark: SparkSession, root: str, name: str, store: str) -> DataFrame:
    """Append a pack's rows to the store, each content once, whatever was imported before: (table, n_new, n_known).

    Equality is that of the SHA-256 of all columns. Only hashes meet; rows that are known never leave their task.
    """
    out = []
    for entry in spark.read.schema(_MANIFEST).json(f"{root}/{name}/manifest").orderBy("table").collect():  # one a table
        if not entry.n_rows:
            continue
        schema = StructType.fromJson(json.loads(entry.columns))
        rows = spark.read.schema(schema).json(f"{root}/{name}/{entry.table}")
        rows = rows.withColumn("content_hash", F.sha2(F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema])), 256))
        path = f"{store}/{entry.table}"
        rows.limit(0).write.mode("append").parquet(path)  # the table exists
        known = spark.read.schema(rows.schema).parquet(path).select("content_hash")
        seen = Observation()
        rows.join(known, "content_hash", "left_anti").dropDuplicates(["content_hash"]).select(*rows.columns).observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
        out.append((entry.table, seen.get["n"], entry.n_rows - seen.get["n"]))
    return spark.createDataFrame(out, "table string, n_new long, n_known long")


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with reasons: the names of all rules that reject a row, in their order; a rule that is null does not."""
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])))


def import_checked(df: DataFrame, rules: dict[str, Column], path: str | None) -> dict[str, int]:
    """Write rows to path/accepted=true and the rejected ones with their reasons to path/accepted=false, in one pass.

    Returns n_rows, n_rejected and the number of rows of each reason, counted in that same pass. Without a path it is a
    dry run: everything is counted, nothing is written.
    """
    seen = Observation()
    has = lambda name: F.count_if(F.array_contains("reasons", name)).alias(name)
    rows = checked(df, rules).withColumn("accepted", F.size("reasons") == 0)
    rows = rows.observe(seen, F.count("*").alias("n_rows"), F.count_if(~F.col("accepted")).alias("n_rejected"), *[has(name) for name in rules])
    if path:
        rows.write.partitionBy("accepted").parquet(path)
    else:
        rows.write.format("noop").mode("overwrite").save()
    return {"n_rows": 0, "n_rejected": 0, **dict.fromkeys(rules, 0), **seen.get}

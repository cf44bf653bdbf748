"""Writers: append, partition overwrite, delta export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import save


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*by or []).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write df over exactly the partitions that it has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def store_by_bucket(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A table in folders by document bucket, the non-negative remainder of an integer key."""
    df.withColumn("bucket", F.pmod(F.col(key), F.lit(buckets)).cast("int")).repartition("bucket", key).write.partitionBy("bucket").parquet(path)


def replace_documents(spark: SparkSession, path: str, new: DataFrame, key: str, buckets: int) -> int:
    """Put new rows in place of all rows of their documents; returns how many buckets keep their files as they were.

    Only the buckets of those documents are read and written; the others are pruned, and their files stay.
    """
    def files_of() -> set[str]:
        return set(spark.read.parquet(path).inputFiles())

    before = files_of()
    own = new.withColumn("bucket", F.pmod(F.col(key), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most one a bucket
    kept = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).join(new.select(key).distinct(), key, "left_anti")
    replace_partitions(save(kept.select(*own.columns).unionByName(own)).repartition("bucket", key), path, ["bucket"])
    bucket = lambda names: {n.rsplit("bucket=", 1)[1].split("/")[0] for n in names}
    return len(bucket(before) - bucket(before ^ files_of()))


def order_and_lines(orders: DataFrame, lines: str, path: str) -> None:
    """Orders with an array column of lines, as a table of headers and one of lines."""
    append(orders.drop(lines), f"{path}/orders")
    append(orders.select("order_id", F.posexplode(lines).alias("line_no", "line")).select("order_id", "line_no", "line.*"), f"{path}/lines")


def export_delta(tables: dict[str, DataFrame], time: str, since: str, path: str) -> DataFrame:
    """Write every table's rows since a moment and return the manifest (table, n_rows)."""
    manifest = None
    for name, df in tables.items():
        own = df.filter(F.col(time) >= F.lit(since).cast("timestamp_ntz"))
        own.write.mode("overwrite").parquet(f"{path}/{name}")
        count = own.sparkSession.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"))
        manifest = count if manifest is None else manifest.unionByName(count)
    return manifest

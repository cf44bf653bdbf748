"""Structured Streaming over events: windows with late data, idempotent merge, folder tailing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str, schema, time: str = "ts") -> DataFrame:
    """A stream of parquet files below folder; the time column becomes a timestamp so that it can be watermarked."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str, keys: list[str], time: str = "ts") -> DataFrame:
    """Counts and sums of value by window and key."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def distinct_within(events: DataFrame, keys: list[str], late: str, time: str = "ts") -> DataFrame:
    """First event of each key within the lateness."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drain(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; running again continues where it ended."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def merge_each(df: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Hand every batch to a merge function that gives the same result if a batch comes twice."""
    df.writeStream.foreachBatch(lambda batch, _: merge(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

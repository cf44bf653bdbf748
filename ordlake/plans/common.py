"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int, *keys: str, each: int = 1 << 16) -> DataFrame:
    """df dealt by keys into tasks of about `each` rows, as many as there are cores at least: a file may be one split, and
    partitions that are joined by their compressed size hold ever more rows as a table grows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], columns: str) -> str:
    """The same literal rows for the oracle."""
    one = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows) + f") AS t({columns})"


def plain(df: DataFrame) -> DataFrame:
    """df with decimals as doubles and dates as text, which every engine prints alike."""
    as_type = lambda kind: "double" if kind.startswith("decimal") else "string" if kind == "date" else kind
    return df.select(*[F.col(c).cast(as_type(kind)).alias(c) for c, kind in df.dtypes])


def sql_doubles(sql: str, *columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)}) FROM ({sql})"

"""The training-data pipeline: toxicity, exact dedup, near dedup, mixing, byte-level BPE.

Every stage takes any table with the columns of documents, also with nulls, empty texts, repeated rows, more columns
of any name, or no rows: null texts count as empty, all columns are carried along, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlake.llm import exact_dedup, minhash, mixing, toxicity
from ordlake.llm.common import PACKED, TEXTS, free_name, save, settled, tables
from ordlake.llm.queries import coded


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model learns from the documents given."""
    model = toxicity.train(docs.select("doc_id", "text"), tables(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity")
    return toxicity.score(docs, model).filter(F.col(f"{name}.score") < toxicity.THRESHOLD).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each cluster."""
    return minhash.drop_near_duplicates(docs)


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target shares of sources, languages and topics."""
    name = free_name(docs, "mix")
    return mixing.mix_documents(docs, out_col=name, stored=lambda df: save(df, "measured", batch=TEXTS, codec=PACKED)).filter(F.col(f"{name}.selected")).drop(name)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the tokens encode and decode to."""
    return save(coded(docs), "tokens", batch=TEXTS)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", sample_mix), ("byte-level BPE", tokens)]

#: Learned scores and hashed sampling have no SQL; tests/llm/test_pipeline.py recomputes every stage in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before has written, which is deleted once its own result is."""

    def after(n: int) -> DataFrame:
        if not n:
            return tables(spark, sf_dir, "documents")
        name, stage = STAGES[n - 1]
        made = lambda: stage(spark, after(n - 1), sf_dir)
        return settled(spark, made, name.replace(" ", "_"), codec=PACKED)

    return after(len(STAGES))

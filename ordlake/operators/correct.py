"""Designations corrected by rules of spelling and then by close names of a catalogue; names resolved by synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.marks import after_ocr
from .match import fuzzy_names, small


def _confidence(base: float, weight: float, most: float, score: Column) -> Column:
    return F.least(F.lit(most), base + score * weight)


def marks(df: DataFrame, key: str, mark: str, catalogue: DataFrame, name: str) -> DataFrame:
    """(key, suggested, confidence, source, reason) of each designation.

    A designation is first spelled as OCR rules have it, then snapped to the closest name of the catalogue with a ratio of
    MARK_STRICT or more. Each distinct spelling is compared once. reason is empty, spelling, close, spelling and close,
    or unchanged; source is brand_db where the catalogue decided or confirmed, else deterministic. Blank designations are
    kept as they are with confidence 0.
    """
    raw = F.trim(F.coalesce(F.col(mark), F.lit("")))
    own = df.select(key, F.coalesce(F.col(mark), F.lit("")).alias("__given"), raw.alias("__raw"), after_ocr(raw).alias("__spelled"))
    known = catalogue.select(F.trim(name).alias("__name")).filter("__name <> ''")
    spelled = own.filter("__raw <> ''").select("__spelled").distinct()
    close = fuzzy_names(spelled, "__spelled", known, "__name", rules.MARK_STRICT, rules.MARK_STRICT, 1).filter("snapped")
    close = close.filter("__name <> __spelled").select("__spelled", F.col("__name").alias("__close"), "score")
    any_known = F.lit(known.limit(1).count() > 0)
    out = own.join(close, "__spelled", "left")
    empty, changed, snapped = F.col("__raw") == "", F.col("__spelled") != F.col("__raw"), F.col("__close").isNotNull()
    cases = [
        (empty, F.lit(0.0), "deterministic", "empty"),
        (changed & snapped, _confidence(*rules.CORRECTED_BOTH, F.col("score")), "brand_db", "spelling and close"),
        (changed, F.lit(rules.CORRECTED_SPELLING), None, "spelling"),
        (snapped, _confidence(*rules.CORRECTED_CLOSE, F.col("score")), "brand_db", "close"),
    ]
    confidence, source, reason = F.lit(rules.CORRECTED_NOTHING), F.lit("deterministic"), F.lit("unchanged")
    for when, sure, where, why in reversed(cases):
        place = F.when(any_known, "brand_db").otherwise("deterministic") if where is None else F.lit(where)
        confidence, source, reason = F.when(when, sure).otherwise(confidence), F.when(when, place).otherwise(source), F.when(when, why).otherwise(reason)
    suggested = F.when(empty, F.col("__given")).otherwise(F.coalesce("__close", "__spelled"))
    return out.select(key, suggested.alias("suggested"), confidence.alias("confidence"), source.alias("source"), reason.alias("reason"))


def resolve_synonym(phrases: DataFrame, key: str, text: str, synonyms: DataFrame) -> DataFrame:
    """(key, code, confidence) of the surest synonym (position, phrase, code, confidence) inside the phrase or around it.

    Case and outer spaces do not count; ties go to the first position. Blank phrases and synonyms, and synonyms without a
    code, meet nothing. The synonyms go to every task as one array, after a check of their number.
    """
    table = synonyms.select((-F.col("confidence")).alias("c"), "position", F.lower(F.trim("phrase")).alias("phrase"), F.trim("code").alias("code")).filter("phrase <> '' AND code <> ''")
    one = small(table).agg(F.sort_array(F.collect_list(F.struct("c", "position", "phrase", "code"))).alias("__synonyms"))
    own = phrases.select(key, F.lower(F.trim(text)).alias("__t")).filter("__t <> ''").join(F.broadcast(one))
    met = F.filter("__synonyms", lambda s: F.contains(F.col("__t"), s["phrase"]) | F.contains(s["phrase"], F.col("__t")))
    return own.select(key, F.get(met, F.lit(0)).alias("s")).filter("s IS NOT NULL").select(key, "s.code", (-F.col("s.c")).alias("confidence"))


def canonical_codes(df: DataFrame, code: str, aliases: DataFrame) -> DataFrame:
    """df with the codes that aliases (alias, code) leads on replaced; other codes stay. An alias has one code: the least."""
    own = small(aliases.groupBy(F.col("alias").alias("__alias")).agg(F.min("code").alias("__code")))
    return df.join(own, F.col(code) == F.col("__alias"), "left").withColumn(code, F.coalesce("__code", code)).drop("__alias", "__code")

"""Readers of text, JSON, CSV and binary inputs; bad rows are set apart and not lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules

#: Schemas (as DDL) of the files that the domain exchanges.
PRICE = "code string, name string, base_cost double, category string, method string, rule_type string, rule_params map<string,string>"
MAPPING = "requirement_pattern string, test_code string, confidence double"
CORRECTION = "doc string, field string, original string, corrected string, mark string, change string, decision string"
OCR_WORD = ["level", "page", "block", "par", "line", "word", "left", "top", "width", "height", "conf", "text"]
SUFFIXES = {"pdf": "pdf", "docx": "docx", "txt": "text", "json": "json", "jsonl": "json", "xlsx": "sheet", "csv": "sheet", "yaml": "rules"}


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def json_table(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, bad records) of JSON lines, or of files that each hold one object or array."""
    if multi_line:
        whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
        bad = whole.filter(F.try_parse_json("value").isNull()).select("path", F.col("value").alias("record"))
        return spark.read.schema(schema).json(path, multiLine=True).withColumn("path", F.input_file_name()), bad
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    lines = spark.read.text(path).withColumn("path", F.input_file_name()).filter(F.trim("value") != "")
    parsed = lines.select("path", "value", F.from_json("value", f"{schema}, __bad string", options).alias("r"))
    return parsed.filter("r.__bad is null").select("r.*", "path").drop("__bad"), parsed.filter("r.__bad is not null").select("path", F.col("value").alias("record"))


def price_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Price catalogue from JSON; rows without a code are dropped, the last of equal codes wins."""
    rows, _ = json_table(spark, path, PRICE, multi_line)
    return rows.filter(F.trim(F.coalesce("code", F.lit(""))) != "").groupBy("code").agg(*[F.max_by(c, F.struct("path", "name")).alias(c) for c in _names(PRICE) if c != "code"])


def corrections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(distinct corrections, bad lines) of JSON lines; reading the same files twice changes nothing."""
    rows, bad = json_table(spark, path, CORRECTION, multi_line=False)
    return rows.dropDuplicates(_names(CORRECTION)), bad


def synonyms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(position, phrase, code, confidence) and (alias, code) of files {"synonyms": [...], "code_aliases": {...}}.

    Synonyms without a phrase or a code are left out; one without a confidence has SYNONYM_CONFIDENCE. Files that lack a
    part, or that are no JSON object, add nothing to it.
    """
    kind = "synonyms array<struct<phrase string, canonical_code string, confidence double>>, code_aliases map<string,string>"
    rows = spark.read.schema(kind).json(path, multiLine=True)
    listed = rows.select(F.posexplode("synonyms").alias("position", "s")).select("position", F.trim("s.phrase").alias("phrase"), F.trim("s.canonical_code").alias("code"), F.coalesce("s.confidence", F.lit(rules.SYNONYM_CONFIDENCE)).alias("confidence"))
    return listed.filter("phrase <> '' AND code <> ''"), rows.select(F.explode("code_aliases").alias("alias", "code")).filter("code IS NOT NULL")


def documents(spark: SparkSession, path: str, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, kind, size, modified, sha256, content) of known files below path, and the unknown ones."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if since:
        reader = reader.option("modifiedAfter", since)
    rows = described(reader.load(path))
    return rows.filter("kind is not null"), rows.filter("kind is null").drop("content")


def described(raw: DataFrame) -> DataFrame:
    """(path, kind, size, modified, sha256, content) of rows of binary files; kind is null for suffixes that are not known."""
    kinds = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return raw.select("path", F.try_element_at(kinds, suffix).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line number, line) of text files."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def ocr_words(lines: Column) -> Column:
    """Words of one OCR table in tab-separated text, with confidence of 0 or more."""
    cells = lambda line: F.split(line, "\t")
    rows = F.transform(F.split(lines, "\r?\n"), lambda line: F.struct(F.get(cells(line), F.lit(10)).try_cast("double").alias("conf"), F.trim(F.coalesce(F.get(cells(line), F.lit(11)), F.lit(""))).alias("text"), *[F.get(cells(line), F.lit(i)).try_cast("int").alias(OCR_WORD[i]) for i in range(6, 10)]))
    return F.filter(rows, lambda w: (w["conf"] >= 0) & (w["text"] != ""))


def json_map(text: Column) -> Column:
    """A JSON object as a map of strings; an empty map for anything else."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def with_fallback(spark: SparkSession, sources: list[DataFrame], least: int) -> DataFrame:
    """The first source with at least so many rows, else the last."""
    for df in sources[:-1]:
        if df.limit(least).count() >= least:
            return df
    return sources[-1]

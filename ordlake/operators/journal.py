"""What an extraction leaves behind: parties of a request with their cards, journal rows, labels led to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import nobody
from ..functions.text import organisation_key

CUSTOMER_KINDS = ["certification_body", "designer"]
JOURNAL = ["doc", "source_type", "customer_org_id", "manufacturer_org_id", "raw_text_length", "marks_count"]


def parties(orgs: DataFrame, doc: str, position: str, own: list[str], given: DataFrame | None = None) -> DataFrame:
    """(doc, customer, manufacturer): names of the two parties among a request's organisations (name, role, org_type).

    Our own laboratory (names own) and placeholders are nobody. The customer is the first organisation in that role or of
    a kind in CUSTOMER_KINDS, the manufacturer the first in that role. Names of given (doc, customer, manufacturer) that an
    operator entered come first. Equal positions are told apart by name. Requests without organisations have no row but for given.
    """
    rows = orgs.filter(~nobody(F.col("name"), own))
    first = lambda c, name: F.min_by("name", F.when(c, F.struct(position, "name"))).alias(name)
    found = rows.groupBy(doc).agg(first((F.col("role") == "customer") | F.col("org_type").isin(CUSTOMER_KINDS), "customer"), first(F.col("role") == "manufacturer", "manufacturer"))
    if given is None:
        return found
    named = lambda c: F.when(~nobody(F.col(c), own), F.trim(c)).alias(f"__{c}")
    both = found.join(given.select(doc, named("customer"), named("manufacturer")), doc, "full")
    return both.select(doc, F.coalesce("__customer", "customer").alias("customer"), F.coalesce("__manufacturer", "manufacturer").alias("manufacturer"))


def with_cards(found: DataFrame, cards: DataFrame) -> DataFrame:
    """found (customer, manufacturer) with customer_org_id and manufacturer_org_id: the least card (org_id, name) of the normalised name, or null.

    Keys are columns before the join, which would else normalise names again for every comparison of its sort. Rows without a name have
    a key of their own, with a sign that no normalised name keeps: else they would all meet in one task.
    """
    known = cards.select(organisation_key(F.col("name")).alias("__key"), "org_id").groupBy("__key").agg(F.min("org_id").alias("__id"))
    out = found
    for party in ("customer", "manufacturer"):
        rows = out.withColumn("__name", organisation_key(F.col(party)))
        alone = F.concat(F.lit('"'), F.xxhash64(*out.columns).cast("string"))
        rows = rows.withColumn("__key", F.when(F.col("__name") == "", alone).otherwise(F.col("__name"))).drop("__name")
        out = rows.join(known.withColumnRenamed("__id", f"{party}_org_id"), "__key", "left").drop("__key")
    return out


def entries(docs: DataFrame, doc: str, text: str, kind: Column, found: DataFrame, marks: DataFrame) -> DataFrame:
    """One journal row (JOURNAL) for each document: its kind, its parties' cards, the length of its text, its number of designations."""
    counts = marks.groupBy(doc).agg(F.count("*").alias("marks_count"))
    rows = docs.select(doc, kind.alias("source_type"), F.coalesce(F.length(text), F.lit(0)).alias("raw_text_length"))
    out = rows.join(found.select(doc, "customer_org_id", "manufacturer_org_id"), doc, "left").join(counts, doc, "left")
    return out.select(F.col(doc).alias("doc"), "source_type", "customer_org_id", "manufacturer_org_id", "raw_text_length", F.coalesce("marks_count", F.lit(0)).cast("long").alias("marks_count"))


def resolve_labels(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """(label_id, document_id, found_by) of labels (label_id, document_id, source_file, label_file) among documents (document_id, path).

    A known id decides. Else the names of the source file, of the label without its suffix and of the label are tried in turn: the
    newest (greatest) document of that file name, then the newest whose path ends with it. Case does not count. found_by is id, name,
    path or null. Every ending of a file name is one key, reduced to its newest document before the join. label_id is unique.
    """
    base = lambda p: F.lower(F.element_at(F.split(p, r"[/\\]"), -1))
    files = documents.select("document_id", base(F.col("path")).alias("f")).filter("f <> ''")
    names = files.groupBy("f").agg(F.max("document_id").alias("d"))
    endings = names.select("d", F.explode(F.transform(F.sequence(F.lit(1), F.length("f")), lambda i: F.substr("f", i))).alias("f")).groupBy("f").agg(F.max("d").alias("by_path"))
    stem = F.regexp_replace(base(F.col("label_file")), r"(?<=.)\.[^.]*$", "")
    tried = F.array(base(F.col("source_file")), stem, base(F.col("label_file")))
    number = F.when(F.trim("document_id").rlike(r"^\d+$"), F.trim("document_id").try_cast("long"))
    rows = labels.select("label_id", number.alias("given"), F.posexplode_outer(tried).alias("turn", "f"))
    met = rows.join(names.withColumnRenamed("d", "by_name"), "f", "left").join(endings, "f", "left")
    hit = F.struct("turn", F.coalesce("by_name", "by_path").alias("d"), F.when(F.col("by_name").isNotNull(), "name").otherwise("path").alias("how"))
    best = met.groupBy("label_id").agg(F.max("given").alias("given"), F.min(F.when(F.col("by_path").isNotNull(), hit)).alias("hit"))
    out = best.join(documents.select(F.col("document_id").alias("by_id")), F.col("given") == F.col("by_id"), "left")
    return out.select("label_id", F.coalesce("by_id", "hit.d").alias("document_id"), F.when(F.col("by_id").isNotNull(), "id").otherwise(F.col("hit.how")).alias("found_by"))

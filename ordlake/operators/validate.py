"""Validation of what was extracted: designations, organisations, whole documents, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.extract import plausible_mark, testing_center
from ..functions.text import squeeze


def _warnings(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(w)) for c, w in pairs]))


def marks(df: DataFrame, doc: str, position: str, ocr: str) -> DataFrame:
    """df (mark, document) with confidence, status, warnings and accepted; a later equal mark of a document is a duplicate."""
    key = F.lower(squeeze(F.col("mark")))
    again = F.row_number().over(Window.partitionBy(doc, "__key").orderBy(position)) > 1
    df = df.withColumn("__key", key).withColumn("__again", again)
    bad, no_doc, used_ocr = ~plausible_mark(F.col("mark")), F.coalesce(F.col("document"), F.lit("")) == "", F.col(ocr)
    base = F.when(used_ocr, 0.75 * rules.OCR_FACTOR).otherwise(0.90)
    c = F.when(bad, F.least(base, F.lit(0.40))).otherwise(base)
    c = F.greatest(c - F.when(no_doc, rules.NO_DOCUMENT).otherwise(0.0), F.lit(0.0))
    c = F.greatest(c - F.when(F.col("__again"), rules.DUPLICATE).otherwise(0.0), F.lit(0.0))
    status = F.when(bad, "error").when(no_doc | F.col("__again"), "warning").otherwise("ok")
    out = df.withColumn("confidence", F.round(c, 2)).withColumn("status", status)
    out = out.withColumn("warnings", _warnings((used_ocr, "P1-1"), (bad, "P1-2"), (no_doc, "P1-3"), (F.col("__again"), "P2-1")))
    return out.withColumn("accepted", ~F.coalesce(bad, F.lit(False))).drop("__key", "__again")  # no error; told without a window over equal marks


def organisations(df: DataFrame, document_type: str) -> DataFrame:
    """df (name, role, org_type, inn, confidence) with checked confidence, status, warnings and read_only."""
    name = F.coalesce(F.col("name"), F.lit(""))
    long, own, letter = F.length(name) > rules.LONG_NAME, (F.col("role") == "customer") & testing_center(name), (F.col(document_type) == "letter") & (F.col("role") == "customer") & (F.coalesce(F.col("inn"), F.lit("")) == "")
    c = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    c = F.when(long, F.least(c, F.lit(0.30))).otherwise(c)
    c = F.when(own, F.least(c, F.lit(0.20))).otherwise(c)
    unsure = (c < 0.60) & ~(long | own)
    final = F.greatest(c - F.when(letter, rules.NO_TAX_ID).otherwise(0.0), F.lit(0.0))
    read_only = (F.col("org_type") == "testing_center") | (~F.col("role").isin("customer", "manufacturer") & testing_center(name))
    return (
        df.withColumn("warnings", _warnings((long, "P0-3"), (own, "P0-1"), (unsure, "P1-4"), (letter, "P1-5")))
        .withColumn("status", F.when(long | own, "error").when(unsure | letter, "warning").otherwise("ok")).withColumn("read_only", read_only).withColumn("confidence", F.round(final, 2))
    )


def edited_customers(checked: DataFrame, edits: DataFrame, doc: str, position: str, document_type: str) -> DataFrame:
    """checked organisations after an operator's edits (doc, customer), one for a document: its first customer has the new name.

    A short name that is no testing centre's is accepted as it is, with a confidence of EDITED or more; any other is validated again as
    a manufacturer's, from the confidence it had. Blank edits count; null ones and documents without a customer change nothing.
    """
    least = F.min(F.when(F.col("role") == "customer", F.col(position))).over(Window.partitionBy(doc))
    own = edits.select(doc, F.trim("customer").alias("__edit"))
    rows = checked.withColumn("__edited", (F.col("role") == "customer") & (F.col(position) == least)).join(own, doc, "left")
    rows = rows.withColumn("__edited", F.coalesce(F.col("__edited"), F.lit(False)) & F.col("__edit").isNotNull())
    fine = (F.length("__edit") <= rules.LONG_NAME) & ~testing_center(F.col("__edit"))
    kept = rows.filter("NOT __edited").select(*checked.columns)
    new = rows.filter("__edited").withColumn("name", F.col("__edit")).withColumn("__fine", fine)
    good = new.filter("__fine").withColumn("status", F.lit("ok")).withColumn("warnings", F.array().cast("array<string>")).withColumn("confidence", F.greatest("confidence", F.lit(rules.EDITED)))
    again = organisations(new.filter("NOT __fine").withColumn("org_type", F.lit("manufacturer")), document_type)
    return kept.unionByName(good.select(*checked.columns)).unionByName(again.select(*checked.columns))


def reports(docs: DataFrame, checked_marks: DataFrame, checked_orgs: DataFrame, doc: str) -> DataFrame:
    """One report per document (columns document_type, n_chars, ocr): flags, block_confirm, overall status and confidence."""
    rank = lambda s: F.when(s == "error", 2).when(s == "warning", 1).otherwise(0)
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    ok = F.col("accepted")
    m = checked_marks.groupBy(doc).agg(F.count("*").alias("n_marks"), F.max(F.when(ok, rank(F.col("status")))).alias("__mr"), F.sum(F.when(ok, cents("confidence"))).alias("__ms"), F.count_if(ok).alias("__mn"))
    party = F.col("role").isin("customer", "manufacturer")
    customer = F.col("role") == "customer"
    o = checked_orgs.groupBy(doc).agg(F.max(F.when(party, rank(F.col("status")))).alias("__or"), F.max(F.when(customer, cents("confidence"))).alias("__oc"), F.bool_or(customer & F.exists("warnings", lambda w: w.startswith("P0-"))).alias("__bad"))
    r = docs.join(m, doc, "left").join(o, doc, "left").withColumn("n_marks", F.coalesce("n_marks", F.lit(0)).cast("long"))
    no_marks, bad, unknown = (F.col("n_marks") == 0) & (F.col("n_chars") > rules.EMPTY_MARKS_CHARS), F.coalesce("__bad", F.lit(False)), F.col("document_type") == "unknown"
    worst = F.greatest(F.coalesce("__mr", F.lit(0)), F.coalesce("__or", F.lit(0)))
    n = F.coalesce("__mn", F.lit(0)) + F.when(F.col("__oc").isNotNull(), 1).otherwise(0)
    total = (F.coalesce("__ms", F.lit(0)) + F.coalesce("__oc", F.lit(0))).cast("decimal(18,0)")
    mean = F.when(n > 0, (F.round(total / n, 0) / 100).cast("double")).otherwise(0.0)
    lowered = unknown & (worst == 0)
    return r.select(
        *docs.columns, "n_marks", _warnings((F.col("ocr"), "P1-1"), (unknown, "P2-2"), (no_marks, "P0-2"), (bad, "P0-1")).alias("flags"), (no_marks | bad).alias("block_confirm"),
        F.when(worst == 2, "error").when((worst == 1) | lowered, "warning").otherwise("ok").alias("overall_status"), F.when(lowered, F.greatest(F.round(mean - rules.UNKNOWN_TYPE, 2), F.lit(0.0))).otherwise(mean).alias("overall_confidence"),
    )


def roles(orgs: DataFrame, doc: str, position: str, is_direction: str) -> DataFrame:
    """orgs with roles set: a testing centre is no party; in a direction the first certification body is the customer,
    and without any customer the first manufacturer also counts as one (as a further row).
    """
    center = (F.col("org_type") == "testing_center") | testing_center(F.col("name"))
    out = orgs.withColumn("org_type", F.when(center, "testing_center").otherwise(F.col("org_type"))).withColumn("role", F.when(center & F.col("role").isin("customer", "manufacturer"), "unknown").otherwise(F.col("role")))
    w = Window.partitionBy(doc)
    first = lambda c: F.min(F.when(c, F.col(position))).over(w)
    body = first(F.col("org_type") == "certification_body")
    out = out.withColumn("role", F.when(F.col(is_direction) & (F.col(position) == body), "customer").otherwise(F.col("role")))
    out = out.withColumn("__c", F.coalesce(F.bool_or(F.col("role") == "customer").over(w), F.lit(False)))
    out = out.withColumn("__m", F.coalesce(first(F.col("role") == "manufacturer"), first(F.col("org_type") == "manufacturer")))
    also = F.col(is_direction) & ~F.col("__c") & (F.col(position) == F.col("__m"))
    both = F.when(also, F.array("role", F.lit("customer"))).otherwise(F.array("role"))  # one reading gives the row and the further one
    return out.withColumn("role", F.explode(both)).select(*orgs.columns)

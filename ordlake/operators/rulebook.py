"""Rules that are rows of a table: families of documents, ordered replacements, ordered phrase rules.

A rule table is small by nature; its size is checked, and it goes to every task as one array, so a text is looked through in its own
row and never copied for a rule. Patterns are regular expressions of the platform and ignore case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import small

#: A family is judged by this many first characters of a document; what a table hint and a known brand add.
HEAD, HINT_BASE, HINT_SHARE, BRAND_BONUS = 4000, 0.25, 0.65, 0.2


def _with_rules(df: DataFrame, rules: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.join(F.broadcast(small(rules).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))))  # one row


def _hit(text: Column, pattern: Column) -> Column:
    return F.rlike(text, F.concat(F.lit("(?iu)"), pattern))


def detect_family(docs: DataFrame, key: str, text: str, families: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, family, score): the family a document resembles most, if it reaches that family's own threshold.

    families has (family, priority, threshold, enabled), rules (family, part, pattern) with part marker, hint, sender or
    brand. The score is the share of markers, hints and senders found; hints found lift it to HINT_BASE + HINT_SHARE of
    their share; a brand's name adds BRAND_BONUS, up to 1. It has two places. Ties go to the lower priority number, then the
    lesser name. family is null and the score that of the best where no threshold is reached; without any family it is 0.
    """
    parts = rules.groupBy("family").agg(*[F.collect_list(F.when(F.col("part") == p, F.col("pattern"))).alias(p) for p in ("marker", "hint", "sender", "brand")])
    table = families.filter("enabled").join(parts, "family", "left")
    none = F.array().cast("array<string>")
    table = table.select("priority", "family", "threshold", *[F.coalesce(p, none).alias(p) for p in ("marker", "hint", "sender", "brand")])
    own = _with_rules(docs.select(key, F.substring(F.coalesce(text, F.lit("")), 1, HEAD).alias("__head")), table, table.columns, "__families")
    head = F.col("__head")

    def judged(f: Column) -> Column:
        n = lambda part: F.size(F.filter(f[part], lambda p: _hit(head, p)))
        total = F.size(f["marker"]) + F.size(f["hint"]) + F.size(f["sender"])
        share = F.when(total > 0, (n("marker") + n("hint") + n("sender")) / total).otherwise(0.0)
        lifted = F.when(n("hint") > 0, F.greatest(share, HINT_BASE + n("hint") / F.size(f["hint"]) * HINT_SHARE)).otherwise(share)
        named = F.exists(f["brand"], lambda b: F.contains(F.lower(head), F.lower(b)))
        score = F.floor(F.when(named, F.least(F.lit(1.0), lifted + BRAND_BONUS)).otherwise(lifted) * 100 + 0.5) / 100
        return F.struct((-F.when(head == "", 0.0).otherwise(score)).alias("s"), f["priority"].alias("p"), f["family"].alias("family"), f["threshold"].alias("t"))

    best = F.array_min(F.transform("__families", judged))
    out = own.select(key, best.alias("b"))
    score = F.coalesce(-F.col("b.s"), F.lit(0.0))
    return out.select(key, F.when((score > 0) & (score >= F.col("b.t")), F.col("b.family")).alias("family"), F.abs(score).alias("score"))


def replace_in_order(df: DataFrame, text: str, rules: DataFrame, out: str) -> DataFrame:
    """df with text after all replacements (position, pattern, replacement), each on what the ones before have left."""
    own = _with_rules(df, rules, ["position", "pattern", "replacement"], "__rules")
    fold = F.aggregate("__rules", F.coalesce(F.col(text), F.lit("")), lambda t, r: F.regexp_replace(t, F.concat(F.lit("(?iu)"), r["pattern"]), r["replacement"]))
    return own.withColumn(out, fold).drop("__rules")


def first_rule(df: DataFrame, text: str, rules: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """df with rule: struct(position, pattern, code) of the first rule (position, pattern, code) that the text meets, else null.

    With known (a table of codes) a first rule whose code is not known counts as none, as in a price list that lacks it.
    """
    if known is not None:
        rules = rules.join(small(known.select(F.col(known.columns[0]).alias("code")).distinct()).withColumn("__known", F.lit(True)), "code", "left")
        rules = rules.select("position", "pattern", F.when(F.col("__known"), F.col("code")).alias("code"))
    own = _with_rules(df, rules, ["position", "pattern", "code"], "__rules")
    met = F.get(F.filter("__rules", lambda r: _hit(F.col(text), r["pattern"])), F.lit(0))
    return own.withColumn("rule", F.when(met["code"].isNotNull(), met)).drop("__rules")


def contained_name(items: DataFrame, key: str, text: str, names: DataFrame, least: int = 8) -> DataFrame:
    """(key, code, name) of the first catalogue name (position, name, code) inside the text or around it; short texts meet none."""
    own = _with_rules(items.select(key, F.lower(F.trim(text)).alias("__t")), names.withColumn("name", F.lower(F.trim("name"))), ["position", "name", "code"], "__names")
    met = F.get(F.filter("__names", lambda n: F.contains(F.col("__t"), n["name"]) | F.contains(n["name"], F.col("__t"))), F.lit(0))
    return own.select(key, F.when(F.length("__t") >= least, met).alias("n")).filter("n IS NOT NULL").select(key, "n.code", "n.name")

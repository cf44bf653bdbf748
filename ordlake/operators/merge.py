"""Changes to tables as functions from old to new: upsert, insert, re-point, guarded delete, delta."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import placeholder
from ..functions.text import organisation_key

#: What happens to a column of a key that both sides have.
OVERWRITE, FILL_NEW, KEEP_OLD, GREATEST = "overwrite", "fill_new", "keep_old", "greatest"


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """old with the rows of new; both have one row per key, and new has the columns of policy.

    overwrite takes the new value, null included; fill_new the new value or else the old; keep_old the old or else
    the new; greatest the larger. Other columns of old stay.
    """
    n = new.select(F.col(key).alias("__key"), F.lit(True).alias("__is_new"), *[F.col(c).alias(f"__n_{c}") for c in policy])
    both = old.join(n, F.col(key) == F.col("__key"), "full")
    how = {
        OVERWRITE: lambda c, x: F.when(F.col("__is_new"), x).otherwise(F.col(c)),
        FILL_NEW: lambda c, x: F.coalesce(x, F.col(c)),
        KEEP_OLD: lambda c, x: F.coalesce(F.col(c), x),
        GREATEST: lambda c, x: F.greatest(F.col(c), x),
    }
    merged = {c: how[p](c, F.col(f"__n_{c}")) for c, p in policy.items()}
    return both.select(*[F.coalesce(key, "__key").alias(key) if c == key else merged.get(c, F.col(c)).alias(c) for c in old.columns])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """old and the rows of new whose key it lacks, one per key."""
    return old.unionByName(latest(new, keys, order).join(old.select(*keys), keys, "left_anti"))


def partial_update(old: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with the non-null values of updates."""
    own = updates.select(key, *[F.col(c).alias(f"__u_{c}") for c in columns])
    joined = old.join(own, key, "left")
    return joined.select(*[F.coalesce(F.col(f"__u_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def survivors(df: DataFrame, key: str, id_col: str, prefer: Column) -> DataFrame:
    """(drop_id, keep_id) of rows that share a key: the preferred row, then the least id, is kept."""
    first = F.min(F.struct((~prefer).alias("p"), F.col(id_col).alias("id")))
    keep = df.groupBy(key).agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    return df.join(keep, key).select(F.col(id_col).alias("drop_id"), F.col("first.id").alias("keep_id")).filter("drop_id <> keep_id")


def repoint(facts: DataFrame, foreign_key: str, merged: DataFrame) -> DataFrame:
    """facts whose references to dropped rows lead to the kept ones."""
    own = merged.select(F.col("drop_id").alias(foreign_key), F.col("keep_id").alias("__keep"))
    return facts.join(own, foreign_key, "left").withColumn(foreign_key, F.coalesce("__keep", foreign_key)).select(*facts.columns)


def guarded_delete(df: DataFrame, key: str, asked: DataFrame, users: list[tuple[DataFrame, str]]) -> DataFrame:
    """df without the asked rows that no user refers to."""
    gone = asked.select(key)
    for table, column in users:
        gone = gone.join(table.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return df.join(gone, key, "left_anti")


def delta(df: DataFrame, time: str, since: str) -> DataFrame:
    """Rows since a moment, that moment included."""
    return df.filter(F.col(time) >= F.lit(since).cast("timestamp_ntz"))


def linked(df: DataFrame, id_col: str, keys: list[str], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, root) of rows that share a non-blank value of any key, however many steps apart; root is the least id.

    Each round takes the least root under every key value and then lets roots follow their own roots, so chains halve. Only
    ids, roots and keys travel; save writes a round and reads it back. A key value that very many rows share is
    reduced in each task first, and its one row is joined back by AQE's split of the skewed side.
    """
    blank = lambda k: F.nullif(F.trim(F.col(k).cast("string")), F.lit(""))
    at = save(df.select(F.col(id_col).alias("id"), F.col(id_col).alias("root"), *[blank(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    while True:
        out = at
        for i in range(len(keys)):
            least = out.filter(F.col(f"k{i}").isNotNull()).groupBy(f"k{i}").agg(F.min("root").alias("least"))
            out = out.join(least, f"k{i}", "left").withColumn("root", F.least("root", "least")).drop("least")
        roots = at.select(F.col("id").alias("root")).join(out.select(F.col("id").alias("root"), F.col("root").alias("further")), "root")
        out = save(out.join(roots, "root", "left").select("id", F.coalesce("further", "root").alias("root"), *[f"k{i}" for i in range(len(keys))]))
        if not out.join(at.select("id", F.col("root").alias("was")), "id").filter("root <> was").limit(1).count():
            return out.select("id", "root")
        at = out


def merge_linked(df: DataFrame, id_col: str, keys: list[str], prefer: Column, fill: list[str], save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(merged rows, (drop_id, keep_id)): one row for all that linked() puts together.

    The preferred row with the least id stays. Its blank columns of fill take the first non-blank value among the dropped
    rows, preferred ones and least ids first. Null ids are left out.
    """
    own = df.filter(F.col(id_col).isNotNull())
    groups = linked(own, id_col, keys, save).select(F.col("id").alias(id_col), "root")
    rows = save(own.join(groups, id_col).withColumn("__order", F.struct((~F.coalesce(prefer, F.lit(False))).alias("p"), F.col(id_col).alias("id"))))
    value = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    firsts = [F.min_by(c, F.when(value(c).isNotNull(), F.col("__order"))).alias(f"__{c}") for c in fill]
    best = rows.groupBy("root").agg(F.min("__order")["id"].alias("keep_id"), *firsts)
    kept = rows.join(best.withColumnRenamed("keep_id", id_col), ["root", id_col])
    merged = kept.select(*[F.coalesce(F.when(value(c).isNotNull(), F.col(c)), F.col(f"__{c}"), F.col(c)).alias(c) if c in fill else F.col(c) for c in df.columns])
    moved = rows.select("root", F.col(id_col).alias("drop_id")).join(best.select("root", "keep_id"), "root").filter("drop_id <> keep_id").select("drop_id", "keep_id")
    return merged, moved


def upsert_organisations(old: DataFrame, new: DataFrame, fill: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cards, (drop_id, keep_id)): new organisations written into old cards (org_id, name, inn, org_type, accredited, fill).

    new has the same columns with position instead of org_id. A new one meets the card of its tax id, else the one
    with its normalised name and the same tax id or none; placeholder names are left out. Of several that meet one card, later positions
    win: the last name, the last known value of each column of fill and the last kind but unknown; a card is accredited
    if any is. Unknown organisations become one card for each tax id, or each name without one, numbered from the greatest org_id on
    by their least position. Where a met card has a tax id, a card of the met name without one is merged into it: blanks are
    filled and it is dropped. org_id and position are unique and not null.
    """
    tax = F.nullif(F.trim(F.coalesce("inn", F.lit(""))), F.lit(""))
    o = old.withColumn("inn", tax).withColumn("__key", organisation_key(F.col("name")))
    n = new.filter(~placeholder(F.col("name"))).withColumn("inn", tax).withColumn("__key", organisation_key(F.col("name")))
    by_tax = o.filter("inn IS NOT NULL").groupBy("inn").agg(F.min("org_id").alias("__by_tax"))
    by_name = o.groupBy("__key", F.coalesce("inn", F.lit("")).alias("__inn")).agg(F.min("org_id").alias("__by_name"))
    met = n.join(by_tax, "inn", "left").withColumn("__inn", F.coalesce("inn", F.lit(""))).join(by_name, ["__key", "__inn"], "left")
    met = met.withColumn("__id", F.coalesce("__by_tax", "__by_name")).withColumn("__unmet", F.when(F.col("__id").isNull(), F.coalesce("inn", F.concat(F.lit("name "), "__key"))))
    last = lambda c, known: F.max_by(c, F.when(known, F.col("position"))).alias(f"__n_{c}")
    given = [last("name", F.lit(True)), last("__key", F.lit(True)), last("org_type", F.col("org_type") != "unknown"), F.max("accredited").alias("__n_accredited"), *[last(c, F.col(c).isNotNull()) for c in ["inn", *fill]]]
    one = met.groupBy("__id", "__unmet").agg(F.min("position").alias("__first"), *given)
    top = old.agg(F.coalesce(F.max("org_id"), F.lit(-1)).cast("long").alias("__top"))
    both = o.join(one.filter("__id IS NOT NULL"), F.col("org_id") == F.col("__id"), "left")
    known = both.select("org_id", F.col("__id").isNotNull().alias("__met"), F.coalesce("__n___key", "__key").alias("__key"), F.coalesce("__n_name", "name").alias("name"), F.coalesce("__n_inn", "inn").alias("inn"), F.coalesce("__n_org_type", "org_type").alias("org_type"), F.greatest("accredited", "__n_accredited").alias("accredited"), *[F.coalesce(f"__n_{c}", c).alias(c) for c in fill])
    added = one.filter("__id IS NULL").join(F.broadcast(top)).select((F.col("__top") + 1 + F.col("__first")).alias("org_id"), F.lit(False).alias("__met"), F.col("__n___key").alias("__key"), F.col("__n_name").alias("name"), F.col("__n_inn").alias("inn"), F.coalesce("__n_org_type", F.lit("unknown")).alias("org_type"), F.col("__n_accredited").alias("accredited"), *[F.col(f"__n_{c}").alias(c) for c in fill])
    cards = known.unionByName(added)
    keepers = known.filter("__met AND inn IS NOT NULL").groupBy("__key").agg(F.min("org_id").alias("keep_id"))
    twins = known.filter("inn IS NULL").join(keepers, "__key")
    moved = twins.select(F.col("org_id").alias("drop_id"), "keep_id")
    spare = twins.groupBy(F.col("keep_id").alias("org_id")).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("org_id"))).alias(f"__t_{c}") for c in fill])
    left = cards.join(moved, F.col("org_id") == F.col("drop_id"), "left_anti").join(spare, "org_id", "left")
    return left.select("org_id", "name", "inn", "org_type", "accredited", *[F.coalesce(c, f"__t_{c}").alias(c) for c in fill]), moved

"""Pricing of tests: how a test is charged, cost of a line, total of an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.money import FINE, MONEY, money, percent


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def rule_type(name: Column, category: Column, code: Column) -> Column:
    """fixed, per_core, per_group or time_based, by code first and then by words of the name."""
    n, c = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    outside, *starts = rules.CLIMATIC_CONTEXT
    climatic = (F.contains(c, F.lit(outside)) | reduce(lambda a, b: a | b, [F.startswith(n, F.lit(s)) for s in starts])) & _any(n, rules.CLIMATIC_WORDS)
    fixed = reduce(lambda a, b: a | b, [F.contains(n, F.lit(x)) & F.contains(n, F.lit(y)) for x, y in rules.FIXED_RATE_PAIRS])
    per_core = F.when(_any(n, rules.PER_GROUP_RESISTANCE_WORDS), "per_group").otherwise("per_core")
    return (
        F.when(F.coalesce(code, F.lit("")).isin(rules.FIXED_RATE_CODES), "fixed").when(climatic, "time_based")
        .when(F.contains(n, F.lit("оптическ")) & F.contains(n, F.lit("волокн")), "per_core").when(fixed, "fixed")
        .when(_any(n, rules.PER_GROUP_WORDS), "per_group").when(_any(n, rules.PER_CORE_WORDS), per_core).otherwise("fixed")
    )


def quantities(tests: DataFrame, explicit: DataFrame, keys: list[str]) -> DataFrame:
    """How often each code is ordered: repeats are counted, a positive explicit quantity counts if larger."""
    counted = tests.filter(F.trim(keys[-1]) != "").groupBy(*keys).agg(F.count("*").alias("n"))
    asked = explicit.filter("quantity > 0").groupBy(*keys).agg(F.max("quantity").alias("asked"))
    return counted.join(asked, keys, "full").select(*keys, F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("asked", F.lit(0))).cast("long").alias("quantity"))


def line_cost(rule: Column, base: Column, quantity: Column, cores: Column, groups: Column, hours: Column, per_hour: Column, default_hours: Column, factor: Column) -> Column:
    """Cost of a line. Unit prices per core, per group and by factor are rounded before the quantity; hours after it.

    Given hours of 0 count as not given. factor applies to 'prepared' lines.
    """
    q = F.greatest(F.lit(1), quantity).cast("decimal(9,0)")
    used = F.coalesce(F.nullif(hours, F.lit(0)), default_hours, F.lit(0))
    times = lambda n: money(base.cast(FINE) * n.cast("decimal(9,4)"))
    timed = money((base.cast(FINE) + per_hour.cast(FINE) * used.cast("decimal(9,2)")) * q)
    each = F.when(rule == "per_core", times(cores)).when(rule == "per_group", times(groups)).when(rule == "prepared", times(factor)).otherwise(money(base))
    return F.when(rule == "time_based", timed).otherwise(money(each * q)).cast(MONEY)


def order_totals(lines: DataFrame, key: str, cost: str, minimum: float, markup: float = 0, discount: float = 0, vat: str = rules.VAT_RATE) -> DataFrame:
    """Subtotal, top-up to the minimum, then markup, discount and tax, for each order."""
    out = lines.groupBy(key).agg(money(F.sum(cost)).alias("subtotal"), F.count("*").alias("n_lines"))
    least = F.lit(minimum).cast(MONEY)
    out = out.withColumn("top_up", F.when(F.col("subtotal") < least, least - F.col("subtotal")).otherwise(0).cast(MONEY))
    adjusted = percent(percent(F.col("subtotal") + F.col("top_up"), markup, 1), discount, -1)
    out = out.withColumn("total_net", money(adjusted))
    return out.withColumn("total_gross", money(F.col("total_net") * (1 + F.lit(vat).cast("decimal(4,2)"))))


def unknown_codes(lines: DataFrame, catalogue: DataFrame, code: str) -> DataFrame:
    """Codes that no price has, with how often they are used."""
    return lines.join(catalogue.select(code).distinct(), code, "left_anti").groupBy(code).agg(F.count("*").alias("n_lines"))


def category_position(category: Column, order: list[str] = rules.CATEGORY_ORDER) -> Column:
    """Place in the fixed order, from 0; others after all of them."""
    found = F.array_position(F.array(*[F.lit(c) for c in order]), F.trim(F.coalesce(category, F.lit("")))).cast("int")
    return F.when(found > 0, found - 1).otherwise(len(order))


def rule_label(rule: Column) -> Column:
    """What is shown for a rule; rules without a label of their own show as fixed."""
    labels = F.create_map(*[F.lit(x) for pair in rules.RULE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, rule), F.lit(rules.RULE_LABELS["fixed"]))

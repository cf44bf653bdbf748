"""Money as DECIMAL(18,2), rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, FINE = "decimal(18,2)", "decimal(18,4)"


def money(x: Column) -> Column:
    """x to two places, half up; doubles pass through four decimal places first."""
    return F.round(x.cast(FINE), 2).cast(MONEY)


def format_money(x: Column) -> Column:
    """1 234 567,89"""
    return F.translate(F.format_number(money(x), 2), ",.", " ,")


def percent(x: Column, by: float, sign: int) -> Column:
    """x changed by a percentage, kept to four places."""
    return (x.cast(FINE) * F.lit(f"{1 + sign * by / 100:.6f}").cast("decimal(9,6)")).cast(FINE)

"""Ratios, rounding and text forms of metric values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def floor2(value: Column) -> Column:
    """Two decimals, cut downwards."""
    return F.floor(value * F.lit(100.0)).cast("double") / F.lit(100.0)


def floor_percent(share: Column) -> Column:
    """A share of 1 as a percentage with two decimals, cut downwards."""
    return F.floor(share * F.lit(10000.0)).cast("double") / F.lit(100.0)


def half_up2(value: Column) -> Column:
    """Two decimals; a half goes up, also below zero."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def money_sum(amount: Column) -> Column:
    """An exact sum of amounts, so the order of rows cannot change the last digit."""
    return F.sum(amount.cast("decimal(28,6)")).cast("double")


def number_text(value: Column) -> Column:
    """A value of at most two decimals without trailing zeros: 97, 98.5, 0.55."""
    return F.regexp_replace(value.cast("decimal(28,2)").cast("string"), r"\.?0+$", "")


def as_number(code: Column) -> Column:
    """A status code as a number; NULL for text that is none. Codes compare as text unless this is used."""
    return code.try_cast("double")

"""Display text for figures.

`format_number` rounds the exact value and breaks ties to even, like most report formatters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency code and unit words shown to users.
CURRENCY = "XOF"
PLUS_MINUS = "±"
DAYS_WORD = "jours"
RANGE_WORD = "au"
NOT_AVAILABLE = "N/A"


def grouped(x: Column, decimals: int = 0) -> Column:
    """1234567.891 -> 1,234,567.89"""
    return F.format_number(x, decimals)


def fixed(x: Column, decimals: int) -> Column:
    """Fixed number of decimals, no thousands separator."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", x, F.lit(pattern))


def money_grouped(x: Column) -> Column:
    return F.concat(F.lit(CURRENCY), grouped(x, 2))


def money(x: Column) -> Column:
    return F.concat(F.lit(CURRENCY), fixed(x, 2))


def percent(x: Column) -> Column:
    return F.concat(fixed(x, 1), F.lit("%"))


def signed_money(x: Column) -> Column:
    """The plus sign goes before the currency, the minus sign stays with the number."""
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), money(x))


def signed_percent(x: Column) -> Column:
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), percent(x))


def plus_minus(x: Column) -> Column:
    return F.concat(F.lit(PLUS_MINUS), fixed(x, 1))


def days(x: Column) -> Column:
    return F.concat(x.cast("string"), F.lit(" " + DAYS_WORD))

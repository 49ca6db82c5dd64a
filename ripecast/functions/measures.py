"""Derived measures of a sale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripecast.functions.calendar import WET_MONTHS

# Demand uplift of the wet season and of weekends.
WET_SEASON_FACTOR = 1.3
WEEKEND_FACTOR = 1.25

MONEY = "decimal(18,2)"
PROFIT = "decimal(18,4)"
TOTAL_MONEY = "decimal(28,2)"
TOTAL_PROFIT = "decimal(28,4)"


def revenue(quantity: Column, unit_price: Column, as_type: str = MONEY) -> Column:
    return (quantity * unit_price).cast(as_type)


def cost(quantity: Column, unit_cost: Column, as_type: str = PROFIT) -> Column:
    return (quantity * unit_cost).cast(as_type)


def profit(revenue_: Column, cost_: Column, as_type: str = PROFIT) -> Column:
    return (revenue_ - cost_).cast(as_type)


def demand_factor(day: Column, product_factor: Column | None = None) -> Column:
    """Expected multiple of base demand on a date: season x weekend x product."""
    season = F.when(F.month(day).between(*WET_MONTHS), F.lit(WET_SEASON_FACTOR)).otherwise(F.lit(1.0))
    weekend = F.when(F.weekday(day) >= 5, F.lit(WEEKEND_FACTOR)).otherwise(F.lit(1.0))
    factor = season * weekend
    return factor if product_factor is None else factor * product_factor.cast("double")

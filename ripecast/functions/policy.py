"""Shelf-life rules: interval width, reorder level, order size and price tier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripecast.functions.numeric import at_least_zero, half_even, truncate

# Business rules of the shelf-life policy.
DEFAULT_SHELF_LIFE = 7
DEFAULT_STOCK = 100
DEFAULT_REORDER_LEVEL = 30
SHORT_LIFE_BELOW = 7                 # strictly shorter lives get the wide interval
SHORT_LIFE_INTERVAL = (0.7, 1.3)
LONG_LIFE_INTERVAL = (0.8, 1.2)
RELAXED_LEVEL_ABOVE = 10             # strictly longer lives keep the plain reorder level
TIGHT_LEVEL_FACTOR = 1.5
ORDER_FACTOR_SHORT_LIFE = 2.5
ORDER_FACTOR = 2.0
HIGHLY_PERISHABLE_UP_TO = 5
MODERATELY_PERISHABLE_UP_TO = 10
LOW_DEMAND_HIGHLY = 10
LOW_DEMAND_MODERATELY = 15
HIGH_DEMAND_LONG_LIFE = 25
DEEP_DISCOUNT, DISCOUNT, PREMIUM = 0.8, 0.9, 1.1


def interval(prediction: Column, shelf_life: Column) -> dict[str, Column]:
    """Rounded forecast and its bounds.

    All three start from the raw prediction. Forecast and lower bound stop at 0, the upper
    bound does not, so a negative prediction gives a negative upper bound.
    """
    short = shelf_life < SHORT_LIFE_BELOW
    low = F.when(short, F.lit(SHORT_LIFE_INTERVAL[0])).otherwise(F.lit(LONG_LIFE_INTERVAL[0]))
    high = F.when(short, F.lit(SHORT_LIFE_INTERVAL[1])).otherwise(F.lit(LONG_LIFE_INTERVAL[1]))
    return {
        "predicted_quantity": at_least_zero(half_even(prediction)),
        "confidence_interval_lower": at_least_zero(half_even(prediction * low)),
        "confidence_interval_upper": half_even(prediction * high),
    }


def adjusted_reorder_level(level: Column, shelf_life: Column) -> Column:
    level = level.cast("double")
    return F.when(shelf_life > RELAXED_LEVEL_ABOVE, level).otherwise(level * TIGHT_LEVEL_FACTOR)


def order_quantity(adjusted_level: Column, shelf_life: Column) -> Column:
    factor = F.when(shelf_life < SHORT_LIFE_BELOW, F.lit(ORDER_FACTOR_SHORT_LIFE)).otherwise(F.lit(ORDER_FACTOR))
    return truncate(adjusted_level * factor)


def price_factor(shelf_life: Column, demand: Column) -> Column:
    """Multiple of the current price: markdown for slow perishables, premium for fast keepers."""
    highly = shelf_life <= HIGHLY_PERISHABLE_UP_TO
    moderately = ~highly & (shelf_life <= MODERATELY_PERISHABLE_UP_TO)
    keeps = shelf_life > MODERATELY_PERISHABLE_UP_TO
    return (
        F.when(highly & (demand < LOW_DEMAND_HIGHLY), F.lit(DEEP_DISCOUNT))
        .when(moderately & (demand < LOW_DEMAND_MODERATELY), F.lit(DISCOUNT))
        .when(keeps & (demand > HIGH_DEMAND_LONG_LIFE), F.lit(PREMIUM))
        .otherwise(F.lit(1.0))
    )


def pricing_strategy(current: Column, suggested: Column) -> Column:
    return (
        F.when(suggested < current, F.lit("Discount"))
        .when(suggested > current, F.lit("Premium"))
        .otherwise(F.lit("Standard"))
    )

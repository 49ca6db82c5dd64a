"""Calendar expressions over a DATE column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the two climate seasons and the months of the wet one.
WET_SEASON = "Saison des Pluies"
DRY_SEASON = "Saison Sèche"
WET_MONTHS = (5, 10)

ISO_DATE = "yyyy-MM-dd"


def date_parts(day: Column) -> dict[str, Column]:
    """Year, month, day, Monday-based weekday, quarter and day of year."""
    return {
        "year": F.year(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "day_of_week": F.weekday(day),
        "quarter": F.quarter(day),
        "day_of_year": F.dayofyear(day),
    }


def is_weekend(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def season_flags(day: Column) -> dict[str, Column]:
    """Four 0/1 meteorological season flags; exactly one is set for any date."""
    quarter_from_december = F.floor((F.month(day) % 12) / F.lit(3)).cast("int")
    order = ("is_winter", "is_spring", "is_summer", "is_fall")
    return {name: (quarter_from_december == i).cast("int") for i, name in enumerate(order)}


def climate_season(day: Column) -> Column:
    return F.when(F.month(day).between(*WET_MONTHS), F.lit(WET_SEASON)).otherwise(F.lit(DRY_SEASON))


def iso(day: Column) -> Column:
    """yyyy-MM-dd; a plain cast of a DATE gives just that, without a detour through timestamps."""
    return day.cast("string")

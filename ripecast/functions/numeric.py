"""Rounding and ratio expressions with the exact conventions the results need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Nearest integer, ties to even, as BIGINT (Spark's own `round` sends ties up)."""
    return F.rint(x).cast("bigint")


def at_least_zero(x: Column) -> Column:
    """x, or 0 if it is negative; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0).cast("bigint"), x))


def truncate(x: Column) -> Column:
    """Integer part, towards zero."""
    return x.cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b as DOUBLE, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sum_or_zero(x: Column) -> Column:
    """Sum in which an empty or all-NULL group counts as 0."""
    return F.coalesce(F.sum(x), F.lit(0))


def row_order(day: Column, tie: Column) -> Column:
    """One BIGINT that sorts like (day, tie), for days up to the year 2300; fails unless 0 <= tie < 2**46.

    A numeric ordering key keeps `min_by` and `max_by` in the hash aggregate; a struct of the
    two would force Spark to sort every input row.
    """
    return F.shiftleft(F.unix_date(day).cast("bigint"), 46) + within(tie.cast("bigint"), 1 << 46, "row order tie")


def within(x: Column, limit: int, name: str) -> Column:
    """x if it is NULL or in [0, limit); anything else fails the job instead of reordering rows."""
    return F.when(x.isNull() | ((x >= 0) & (x < limit)), x).otherwise(
        F.raise_error(F.concat(F.lit(f"{name} must be in [0, {limit}): "), x.cast("string"))).cast("bigint"))


def content_tie(*columns: Column) -> Column:
    """A reproducible tie-break in [0, 2**46) from row contents, for tables without row numbers."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 18)

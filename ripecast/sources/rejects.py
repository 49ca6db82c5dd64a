"""Dirty input rows: accepted and rejected in one pass, with the reason beside each rejected value.

Every check is an expression over the row, so one scan decides all of them. The rows are written once to the shared folder with
what is wrong with them; accepted rows and the side table of rejects are both read from there, so that together they are
exactly what was read, also if the input changes meanwhile.

Columns may be text, as a CSV without schema gives them, or typed already. A value that is missing, blank text included, is a
reason to reject the row only in a column that must have one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.functions import calendar
from ripecast.sources import contracts
from ripecast.sources.files import materialize

MISSING = "missing"
NOT_A_DATE = "not a date"
NOT_A_NUMBER = "not a number"
NOT_WHOLE = "not a whole number"
OUT_OF_RANGE = "out of range"
NEGATIVE = "negative"

# Columns without which a row means nothing, and those that can't be below zero.
NEEDED = ("date", "product_id", "quantity_sold", "current_stock")
NOT_NEGATIVE = ("quantity_sold", "unit_price", "shelf_life_days", "current_stock", "reorder_level")

PROBLEMS = "array<struct<column:string,reason:string,value:string>>"


class Sorted(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame  # row, column, reason, value, record
    stored: DataFrame

    def counts(self) -> DataFrame:
        """One row: rows read, accepted and rejected."""
        bad = F.size("problems") > 0
        return self.stored.agg(
            F.count("*").alias("n_read"), F.count_if(~bad).alias("n_accepted"), F.count_if(bad).alias("n_rejected"))


def _reason(df: DataFrame, field: T.StructField) -> Column:
    """Why the value can't go into the contract's column, null if it can."""
    name, kind = field.name, field.dataType
    is_text = isinstance(df.schema[name].dataType, T.StringType)
    value = F.col(name)
    missing = value.isNull() | (F.trim(value) == "") if is_text else value.isNull()
    reason = F.when(missing, F.lit(MISSING) if name in NEEDED else F.lit(None))
    if isinstance(kind, T.DateType):
        return reason.when(F.try_to_date(value, calendar.ISO_DATE).isNull(), F.lit(NOT_A_DATE)) if is_text else reason
    if not isinstance(kind, T.NumericType):
        return reason
    trimmed = F.trim(value) if is_text else value
    number, exact = trimmed.try_cast("double"), trimmed.try_cast(kind)
    if is_text:
        reason = reason.when(number.isNull() | F.isnan(number), F.lit(NOT_A_NUMBER))
    if isinstance(kind, T.IntegralType):
        reason = reason.when(number != F.rint(number), F.lit(NOT_WHOLE))
    reason = reason.when(exact.isNull(), F.lit(OUT_OF_RANGE))
    return reason.when(number < 0, F.lit(NEGATIVE)) if name in NOT_NEGATIVE else reason


def sort_out(df: DataFrame, schema: T.StructType = contracts.SALES_SCHEMA, aliases: dict[str, str] = contracts.SALES_ALIASES,
             required: tuple[str, ...] = contracts.REQUIRED_SALES) -> Sorted:
    """Rows of an export whose values fit the contract, and the others with every reason. Missing columns are an error of the table, not of rows."""
    df = df.withColumnsRenamed(aliases)
    contracts.require_columns(df, required, "table")
    checked = [f for f in schema if f.name in df.columns and f.name != "row_order"]
    found = [F.when(r.isNotNull(), F.struct(
        F.lit(f.name).alias("column"), r.alias("reason"), F.col(f.name).cast("string").alias("value")))
        for f in checked for r in [_reason(df, f)]]
    problems = F.filter(F.array(*found), lambda p: p.isNotNull()).cast(PROBLEMS)
    record = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("record")
    stored = materialize(df.select(record, problems.alias("problems"), F.monotonically_increasing_id().alias("row")), "sorted-rows")
    clean = stored.filter(F.size("problems") == 0).select("record.*")
    numeric = {f.name: F.trim(F.col(f.name)) for f in checked
               if isinstance(f.dataType, T.NumericType) and isinstance(clean.schema[f.name].dataType, T.StringType)}
    blank = {n: F.when(c != "", c) for n, c in numeric.items()}
    rejected = stored.filter(F.size("problems") > 0).select("row", F.to_json("record").alias("record"), F.inline("problems")).select(
        "row", "column", "reason", "value", "record")
    return Sorted(clean.withColumns(blank) if blank else clean, rejected, stored)


def sort_out_inventory(df: DataFrame) -> Sorted:
    return sort_out(df, contracts.INVENTORY_SCHEMA, contracts.INVENTORY_ALIASES, contracts.REQUIRED_INVENTORY)

"""Least squares on the calendar, price and shelf-life features, one model per product.

A single product's features are collinear: price and shelf life seldom move, the season flags add up to 1. The
solution wanted is the one with the smallest norm. A product's days meet in one partition; sums of products of two columns, whole
numbers but for the price, and all that follows are numpy over blocks of products:

1. Pivoted Cholesky elimination of the centred sums G gives columns L with G = L L' and as many of them as G has independent
   columns, and u with b = L u.
2. Elimination of the small system (L' L) v = u gives the coefficients L v: they lie in the row space of the features, so no
   other solution has a smaller norm.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripecast.operators.features import PRODUCT_FEATURES, TARGET, with_calendar

# Ship the code with the job, so that executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A column is left out if what the others leave of its spread is below this share of it: rounding noise.
RELATIVE_CUTOFF = 1e-9
# A column counts as constant if its squared spread is below this share of the largest one.
CONSTANT_CUTOFF = 1e-20
PRICE = PRODUCT_FEATURES.index("unit_price")

SIZE = len(PRODUCT_FEATURES)
BLOCK_ROWS = 512          # products solved side by side: their matrices stay in the cache


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by product, in pieces that hold all days of their products, and where each product starts."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        if not len(rows):
            continue
        own = rows.column(key).combine_chunks()
        starts = np.append(0, 1 + np.flatnonzero(pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)))
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts[:-1]
        held = rows.slice(int(starts[-1]))
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _sums(rows: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Per product: days, sums of the columns and of their products, over the days with `used` if there are such.

    `pairs` holds the upper triangle, row by row. A missing value adds nothing.
    """
    def known(name: str, missing: float = 0.0) -> np.ndarray:
        return rows.column(name).fill_null(missing).to_numpy()

    used = known("used", False).astype(bool)
    whose = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(used))))
    at = np.flatnonzero(used | ~np.logical_or.reduceat(used, starts)[whose])
    n_days, whose = np.add.reduceat(used.astype(np.int64), starts), whose[at]
    starts = np.searchsorted(whose, np.arange(len(starts)))

    there = rows.column("unit_price").is_valid().to_numpy()[at]
    price = known("unit_price")[at]
    # Prices are measured from the product's lowest, so that a constant one is exactly zero.
    base = np.fmin.reduceat(np.where(there, price, np.nan), starts)
    x = np.stack([known(c)[at] for c in PRODUCT_FEATURES], 1)
    x[:, PRICE] = np.where(there, price - base[whose], 0.0)
    y = known(TARGET)[at]
    total = lambda values: np.add.reduceat(values, starts, axis=0)
    first, second = np.triu_indices(SIZE)
    return {
        "n": total(rows.column(TARGET).is_valid().to_numpy()[at].astype(np.float64)), "sum_y": total(y), "sums": total(x),
        "with_y": total(x * y[:, None]), "pairs": total(x[:, first] * x[:, second]), "base": base,
        "priced": np.logical_or.reduceat(there, starts), "n_days": n_days}


def solve(n: np.ndarray, y: np.ndarray, x: np.ndarray, xy: np.ndarray, pairs: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (products x SIZE) and intercepts from the sums of a block of products, each step for all of them at once.

    Sums run over the columns in order, so a product's solution does not depend on the others of its block.
    """
    m, at = SIZE, np.arange(len(n))
    first, second = np.triu_indices(m)
    xx = np.empty((len(n), m, m))
    xx[:, first, second] = xx[:, second, first] = pairs
    with np.errstate(all="ignore"):
        g = n[:, None, None] * xx - x[:, :, None] * x[:, None, :]
        b = n[:, None] * xy - x * y[:, None]
        spread = g.diagonal(axis1=1, axis2=2).copy()
        least = np.where(spread > CONSTANT_CUTOFF * spread.max(1, keepdims=True), RELATIVE_CUTOFF * spread, np.inf)

        # Columns l and numbers u of the pivoted Cholesky elimination; an unneeded column is zero.
        l, u = np.empty((len(n), m, m)), np.empty((len(n), m))
        for k in range(m):
            left = g.diagonal(axis1=1, axis2=2)
            left = np.where(~(left <= least), left, 0.0)
            p = left.argmax(1)
            top = left[at, p]
            root, needed = np.sqrt(top), ~(top <= 0)
            l[:, k] = np.where(needed[:, None], g[at, p] / root[:, None], 0.0)
            u[:, k] = np.where(needed, b[at, p] / root, 0.0)
            g -= l[:, k, :, None] * l[:, k, None, :]
            g[at, p] = 0.0
            g[at, :, p] = 0.0
            b -= l[:, k] * u[:, k, None]

        # (L'L) v = u by Gauss-Jordan elimination; for an unneeded column a one on the diagonal.
        q = np.zeros((len(n), m, m))
        q[:, range(m), range(m)] = (l == 0).all(2)
        for i in range(m):
            q += l[:, :, None, i] * l[:, None, :, i]
        for k in range(m):
            f = q[:, :, k] / q[:, k, k, None]
            f[:, k] = 0.0
            q -= f[:, :, None] * q[:, None, k]
            u -= f * u[:, k, None]
        v = u / q.diagonal(axis1=1, axis2=2)

        w, explained = np.zeros((len(n), m)), np.zeros(len(n))
        for i in range(m):
            w += l[:, i] * v[:, i, None]
        for i in range(m):
            explained += w[:, i] * x[:, i]
        return w, (y - explained) / n - w[:, PRICE] * base


def _solved(rows: DataFrame, key: str) -> DataFrame:
    """(key, coefficients, intercept, n_days) of rows that lie together and in order by product."""
    def solutions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for days, starts in _runs(batches, key):
            got = _sums(days, starts)
            if not got["n"].all():
                raise ValueError("least squares: a product without any known quantity")
            keys = days.column(key).combine_chunks().take(pa.array(starts))
            for a in range(0, len(starts), BLOCK_ROWS):
                n, y, x, xy, pairs, base, priced, n_days = (
                    got[c][a:a + BLOCK_ROWS] for c in ("n", "sum_y", "sums", "with_y", "pairs", "base", "priced", "n_days"))
                w, intercept = solve(n, y, x, xy, pairs, base)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(a, BLOCK_ROWS), pa.ListArray.from_arrays(np.arange(0, w.size + 1, SIZE, dtype=np.int32), w.ravel()),
                    # A product without any price has no level to start from.
                    pa.array(intercept, mask=~priced), pa.array(n_days)], names=[key, "coefficients", "intercept", "n_days"])

    return rows.mapInArrow(solutions, T.StructType([
        T.StructField(key, rows.schema[key].dataType), T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType()), T.StructField("n_days", T.LongType())]))


def fit(daily: DataFrame, products: DataFrame, key: str = "product_id", train_flag: Column | None = None) -> DataFrame:
    """(key, coefficients, intercept, n_days) per product; n_days counts the days with `train_flag`. `daily` needs the day's mean `unit_price`.

    Only rows with `train_flag` enter the fit, unless a product has none: then all of its rows do.
    """
    used = F.lit(True) if train_flag is None else F.coalesce(train_flag, F.lit(False))
    rows = daily.withColumn("used", used).join(products.select(key, "shelf_life_days"), key)
    # A product has at most a calendar's worth of days; they stay in one partition.
    rows = with_calendar(rows.repartition(key).sortWithinPartitions(key))
    return _solved(rows.select(key, "used", *(F.col(c).cast("double").alias(c) for c in (*PRODUCT_FEATURES, TARGET))), key)


def prediction() -> Column:
    """Expected quantity of a row that has PRODUCT_FEATURES and the columns `fit` produces."""
    terms = [
        F.get("coefficients", F.lit(i)) * F.col(c).cast("double") for i, c in enumerate(PRODUCT_FEATURES)
    ]
    return sum(terms, F.col("intercept"))

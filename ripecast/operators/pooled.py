"""Models pooled over all products: the random forest, and linear regression from one pass of sums."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripecast.operators import forest
from ripecast.operators.features import FEATURES, TARGET

# Executors need not have the package: functions that run there are sent with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Hyperparameters of the forest.
TREES = 100
LIMITS = forest.Limits(depth=10, min_split=5, min_leaf=2)
SEED = 42

# The linear fit's sums are floating point and follow partitions, so their number is part of the model: never taken from
# cores, files or rows. Raise it with the data, to about 128 MB of training rows per partition.
PARTITIONS = 64

# One forest serves all products, so it also gets the product's level.
LEVEL = "product_mean_quantity"
POOLED_FEATURES = (*FEATURES, LEVEL)
MODEL_TYPES = ("random_forest", "linear_regression")

# Directions in which the standardised features vary less than this share of the largest are taken as collinear.
COLLINEAR = 1e-11

#: Rows, means, and sums of products of the deviations from the means.
Sums = tuple[int, np.ndarray, np.ndarray]


def check_model_type(model_type: str, allowed: tuple[str, ...] = MODEL_TYPES) -> None:
    if model_type not in allowed:
        raise ValueError(f"unknown model type {model_type!r}, choose from {', '.join(allowed)}")


def product_level(train: DataFrame, key: str) -> DataFrame:
    """Mean daily quantity of every product, over training rows only."""
    return train.groupBy(key).agg(
        (F.sum(TARGET).cast("double") / F.count(TARGET).cast("double")).alias(LEVEL)
    )


def joined(a: Sums, b: Sums) -> Sums:
    """The sums of both sets of rows; deviations from a common mean lose no digits to large values."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def sums_of(dealt: DataFrame) -> Sums | None:
    """The sums over all rows, added up by partition and then in the partitions' order; None if there are no rows.

    A null, NaN or infinite value is refused.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            if b.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                if not np.isfinite(x).all():
                    bad = [n for n, ok in zip(b.schema.names, np.isfinite(x).all(axis=1), strict=True) if not ok]
                    raise ValueError(f"training rows with a null, NaN or infinite value: {', '.join(bad)}")
                mean = x.mean(axis=1)
                x -= mean[:, None]
                # Not by BLAS, whose order of adding may follow the number of cores.
                own = b.num_rows, mean, np.einsum("in,jn->ij", x, x)
                found = own if found is None else joined(found, own)
        if found is not None:
            n, mean, cross = found
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64()),
                "mean": pa.array([mean]), "products": pa.array([cross.ravel()])})

    # One row of 18 x 17 numbers per partition.
    parts = dealt.mapInArrow(add, "part int, n bigint, mean array<double>, products array<double>").collect()
    sums = [(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(r["mean"]), -1))
            for r in sorted(parts, key=lambda r: r["part"])]
    return functools.reduce(joined, sums) if sums else None


def least_squares(sums: Sums) -> tuple[np.ndarray, float]:
    """Coefficients and intercept for the last column by the others: of all least-squares fits the one with the smallest standardised coefficients."""
    n, mean, cross = sums
    spread = np.sqrt(np.diag(cross) / n)
    # A constant column tells nothing; its mean is known to 16 digits only.
    varies = spread > 1e-12 * np.abs(mean)
    unit = np.where(varies, spread, 1.0)
    share = np.where(np.outer(varies, varies), cross / n / np.outer(unit, unit), 0.0)
    value, vector = np.linalg.eigh(share[:-1, :-1])
    kept = value > COLLINEAR * max(value[-1], 0.0)
    vector = vector[:, kept]
    coefficients = vector @ ((vector.T @ share[:-1, -1]) / value[kept]) * unit[-1] / unit[:-1]
    return coefficients, float(mean[-1] - mean[:-1] @ coefficients)


class Line:
    """A fitted line as a table (feature, coefficient); the intercept is the row without a feature."""

    def __init__(self, table: DataFrame, names: tuple[str, ...]):
        self.table = table
        known = {r["feature"]: r["coefficient"] for r in table.collect()}
        self.coefficients, self.intercept = {c: known[c] for c in names}, known[None]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `prediction`; a row with a null or NaN feature is refused."""
        def given(name: str) -> Column:
            value = F.col(name).cast("double")
            return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"null or NaN in {name}")).cast("double")).otherwise(value)

        return df.withColumn("prediction", sum((given(c) * F.lit(w) for c, w in self.coefficients.items()), F.lit(0.0)) + F.lit(self.intercept))


def fit_line(train: DataFrame, partitions: int) -> Line:
    columns = (*POOLED_FEATURES, TARGET)
    rows = train.select(*(F.col(c).cast("double") for c in columns))
    sums = sums_of(rows.repartition(partitions, *columns).sortWithinPartitions(*columns))
    if sums is None:
        raise ValueError("no training rows")
    coefficients, intercept = least_squares(sums)
    table = [*zip(POOLED_FEATURES, coefficients.tolist(), strict=True), (None, intercept)]
    return Line(train.sparkSession.createDataFrame(table, "feature string, coefficient double").coalesce(1), POOLED_FEATURES)


def fit(train: DataFrame, model_type: str = "random_forest", trees: int = TREES, partitions: int = PARTITIONS) -> forest.Forest | Line:
    """Trains on rows that have POOLED_FEATURES, the target, product_id and date.

    The forest draws rows by their product and date. The linear fit reads its rows once, for the sums of products that the least
    squares need. They are dealt by their values over `partitions` and sorted there, so that the same rows give the same
    model on any number of cores.
    """
    check_model_type(model_type)
    if model_type == "random_forest":
        return forest.fit(train, POOLED_FEATURES, TARGET, ("product_id", "date"), trees, SEED, LIMITS)
    return fit_line(train, partitions)


def predict(model: forest.Forest | Line | PipelineModel | None, df: DataFrame) -> DataFrame:
    """Adds `prediction` to rows that have POOLED_FEATURES."""
    if model is None:
        raise ValueError("untrained model: fit it before predicting")
    if isinstance(model, PipelineModel):  # saved before the fit had coefficients of its own
        return model.transform(df).drop("features")
    return model.predict(df)

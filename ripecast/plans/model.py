"""Train once, then forecast, plan stock and price for all products; save and load."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ripecast.functions import policy
from ripecast.operators import (
    demand, evaluate, explore, features, forecast, forest, linear, pooled, pricing, products, replenish, trend,
)
from ripecast.sources import files
from ripecast.sources.files import materialize, shared_path

PER_PRODUCT = ("trend", "linear_regression")
POOLED = {"random_forest": "random_forest", "pooled_linear_regression": "linear_regression"}
MODEL_TYPES = (*PER_PRODUCT, *POOLED)


ABOUT = (
    "model_type string, fit_on string, trees int, partitions int, features array<string>, target string, "
    "parts array<struct<name string, n_rows bigint, checksum bigint>>")


def _checksum(part: DataFrame) -> tuple[Column, Column]:
    """Rows, and a sum over them that no order and no partitioning changes."""
    # Added up as decimals, which can't overflow; equal rows don't cancel out as they would by exclusive or.
    h = F.xxhash64(*part.columns).cast("decimal(20,0)")
    total = F.coalesce(F.sum(h), F.lit(0).cast("decimal(30,0)"))
    return F.count(F.lit(1)).alias("rows"), F.pmod(total, F.lit(1 << 61).cast("decimal(20,0)")).cast("bigint").alias("checksum")


class DemandModel:
    """A demand model over a sales table in contract form.

    trend                     straight line per product
    linear_regression         least squares on the feature list, per product
    random_forest             one forest for all products
    pooled_linear_regression  one least-squares fit for all products

    `fit_on="train"` leaves the held-out fifth of the days out of the fit, `"all"` uses every day.
    Missing prices of a day are filled with the product's mean price, then with the mean over all products.
    `partitions` is the number of parts that the pooled linear fit adds up, saved with the model.
    """

    def __init__(self, model_type: str = "random_forest", fit_on: str = "train", trees: int = pooled.TREES,
                 partitions: int = pooled.PARTITIONS):
        pooled.check_model_type(model_type, MODEL_TYPES)
        if fit_on not in ("all", "train"):
            raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
        self.model_type, self.fit_on, self.trees, self.partitions = model_type, fit_on, trees, partitions
        self._per_product: DataFrame | None = None    # coefficients, or codes and level, by product_id
        self._codes: DataFrame | None = None
        self._pipeline: forest.Forest | pooled.Line | PipelineModel | None = None
        self._test: DataFrame | None = None
        self._fitted: DataFrame | None = None
        self._profile: DataFrame | None = None

    # -- training --------------------------------------------------------------------------

    def train(self, sales: DataFrame) -> DemandModel:
        return self.train_days(demand.product_daily(sales), products.profile(sales))

    def train_days(self, daily: DataFrame, profile: DataFrame) -> DemandModel:
        """Trains on demand already summed per product and day, and one row per product."""
        # Both are far smaller than the sales, and fit, metrics and forecast read them: stored once.
        profile = materialize(profile, "products")
        marked = demand.split(daily)
        if self.model_type != "trend":
            if "unit_price" not in marked.columns:
                marked = marked.withColumn("unit_price", F.lit(None).cast("double"))
            usual = profile.agg(F.coalesce(F.avg("mean_price"), F.lit(0.0))).first()[0]
            prices = profile.select("product_id", F.coalesce("mean_price", F.lit(usual)).alias("known_price"))
            marked = marked.join(prices, "product_id").withColumn(
                "unit_price", F.coalesce(F.col("unit_price").cast("double"), "known_price")).drop("known_price")
        marked = materialize(marked, "product-days")
        used = F.lit(True) if self.fit_on == "all" else F.col("is_test") == 0
        # What was fitted is stored, so that forecast, stock plan and prices share one fit.
        if self.model_type == "trend":
            self._per_product = materialize(trend.fit(marked, train_flag=used), "trend")
        elif self.model_type == "linear_regression":
            fitted = linear.fit(marked, profile, train_flag=used).join(prices, "product_id")
            self._per_product = materialize(fitted, "linear")
        else:
            self._train_pooled(marked.filter(used), profile, prices)
        self._test = marked.filter(F.col("is_test") == 1)
        self._fitted = marked.filter(used)
        self._profile = profile
        return self

    def _train_pooled(self, rows: DataFrame, profile: DataFrame, prices: DataFrame) -> None:
        self._codes = features.label_codes(profile)
        self._per_product = materialize(
            prices.join(pooled.product_level(rows, "product_id"), "product_id", "left"), "product-level")
        coded = self._attach(profile).select(
            "product_id", "shelf_life_days", pooled.LEVEL, *(f"{c}_encoded" for c in features.ENCODED)
        )
        table = features.with_calendar(rows.join(coded, "product_id"))
        table = table.withColumn(pooled.LEVEL, F.coalesce(F.col(pooled.LEVEL), F.lit(0.0)))
        self._pipeline = pooled.fit(table, POOLED[self.model_type], self.trees, self.partitions)

    def metrics(self, *by: str) -> DataFrame:
        """Accuracy on the held-out days, over all products or by `product_id`."""
        self._require_trained()
        known = self._attach(self._profile.drop("first_date", "last_date"))
        predicted = F.col("prediction")
        if self.model_type in PER_PRODUCT:
            # A product that was fitted on no training day would be scored by its own answers.
            predicted = F.when(F.col("n_days") > 0, predicted)
        pairs = self._score(self._test.join(known, "product_id")).select(
            "product_id", F.col("quantity_sold").alias("actual"), predicted.alias("predicted")
        )
        return evaluate.metrics(pairs, *by)

    def products(self) -> DataFrame:
        """The products trained on, one row each."""
        self._require_trained()
        return self._profile

    def tree_nodes(self) -> DataFrame:
        """The forest's nodes: tree, node, feature and threshold (null in a leaf), rows drawn and their mean."""
        self._require_trained()
        if self.model_type != "random_forest":
            raise ValueError(f"a {self.model_type} model has no trees")
        return self._pipeline.table

    def fitted_days(self) -> DataFrame:
        """The days a per-product model was fitted on, with features, quantity and prediction."""
        self._require_trained()
        if self._fitted is None:
            raise ValueError("the fitted days are known in the training session only")
        known = self._attach(self._profile.drop("first_date", "last_date"))
        return self._score(self._fitted.join(known, "product_id"))

    # -- prediction ------------------------------------------------------------------------

    def _require_trained(self) -> None:
        if self._per_product is None:
            raise ValueError("untrained model: call train or load first")

    def _attach(self, df: DataFrame) -> DataFrame:
        """Adds what the model knows about a product; cheapest on one row per product."""
        known = self._per_product
        if self.model_type == "trend":
            return df.drop("first_date").join(known.select("product_id", "intercept", "slope", "first_date", "n_days"),
                                              "product_id", "left")
        if self.model_type == "linear_regression":
            return df.join(known, "product_id", "left")
        # One row: what a product that was not trained on gets.
        usual = known.agg(F.avg(pooled.LEVEL), F.avg("known_price")).first()
        return features.encode(df, self._codes).join(known, "product_id", "left").withColumns({
            pooled.LEVEL: F.coalesce(F.col(pooled.LEVEL), F.lit(usual[0] or 0.0)),
            "known_price": F.coalesce("known_price", F.lit(usual[1] or 0.0)),
        })

    def _score(self, df: DataFrame) -> DataFrame:
        """Adds `prediction` to dated rows that went through `_attach`."""
        if self.model_type == "trend":
            return df.withColumn("prediction", trend.prediction(F.col("date")))
        rows = features.with_calendar(df)
        if "unit_price" in rows.columns:
            rows = rows.withColumn("unit_price", F.coalesce(F.col("unit_price").cast("double"), "known_price"))
        else:
            rows = rows.withColumn("unit_price", F.col("known_price"))
        if self.model_type == "linear_regression":
            return rows.withColumn("prediction", linear.prediction())
        return pooled.predict(self._pipeline, rows)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `prediction` to rows with date, product attributes and unit price.

        Products the model has not seen get no prediction from a per-product model, and their
        own label code with an average level from a pooled one.
        """
        self._require_trained()
        return self._score(self._attach(df)).select(*df.columns, "prediction")

    def _future(
        self, sales: DataFrame | None, product_id: str | None, days_ahead: int,
        stock: DataFrame | None = None, current_stock: int | None = None, base_price: float | None = None,
        profile: DataFrame | None = None,
    ) -> DataFrame:
        """Forecast days with the product's attributes. All joins come before the days multiply.

        Every product of the input has its days; one that a per-product model has not seen has them without a forecast.
        """
        self._require_trained()
        forecast.check_horizon(days_ahead)
        if profile is None:
            profile = self._profile if sales is None else products.profile(sales)
        if product_id is not None:
            profile = explore.by_product_id(profile, product_id)
        known = self._attach(profile).withColumn("unit_price", F.col("mean_price"))
        if stock is not None and current_stock is None:
            known = products.with_stock(known, products.latest_stock(stock))
        else:
            level = policy.DEFAULT_STOCK if current_stock is None else current_stock
            known = known.withColumn("current_stock", F.lit(level).cast("bigint"))
        if base_price is not None:
            known = known.withColumn("base_price", F.lit(float(base_price)))
        if self.model_type == "random_forest":
            # A row per product, dealt anew: walking the trees costs more than moving it, and days follow their product.
            known = known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), "product_id")
        days = self._score(forecast.future_days(known, days_ahead))
        return forecast.with_intervals(days, F.col("prediction"))

    def forecast_demand(
        self, sales: DataFrame | None = None, product_id: str | None = None,
        days_ahead: int = forecast.DEFAULT_HORIZON, profile: DataFrame | None = None,
    ) -> DataFrame:
        """Forecast with intervals for the days after each product's last sale, NULL where the model knows no product.

        Without `sales` it is for the products trained on, as they were then; `profile` gives them
        as one row per product.
        """
        return forecast.contract(self._future(sales, product_id, days_ahead, profile=profile))

    def stock_projection(
        self, sales: DataFrame, inventory: DataFrame | None = None, product_id: str | None = None,
        reorder_level: int = policy.DEFAULT_REORDER_LEVEL, current_stock: int | None = None,
    ) -> DataFrame:
        """Stock left after each forecast day.

        It starts from `current_stock`, else from the latest `inventory` row, else from the default.
        """
        days = self._future(sales, product_id, forecast.DEFAULT_HORIZON, inventory, current_stock)
        return replenish.stock_projection(days, reorder_level)

    def forecast_inventory_replenishment(
        self, sales: DataFrame, inventory: DataFrame | None = None, product_id: str | None = None,
        reorder_level: int = policy.DEFAULT_REORDER_LEVEL, current_stock: int | None = None,
    ) -> DataFrame:
        """When and how much to reorder; no row for a product whose stock lasts. Stock as in `stock_projection`."""
        days = self._future(sales, product_id, forecast.DEFAULT_HORIZON, inventory, current_stock)
        return replenish.reorder_plan(days, reorder_level)

    def optimize_pricing(
        self, sales: DataFrame, product_id: str | None = None, base_price: float | None = None,
        days_ahead: int = pricing.DEFAULT_DAYS,
    ) -> DataFrame:
        """Price suggestions from `base_price`, or from each product's first price."""
        return pricing.suggest(self._future(sales, product_id, days_ahead, base_price=base_price))

    # -- persistence -----------------------------------------------------------------------

    def _parts(self) -> dict[str, DataFrame]:
        """Everything the model knows, as tables."""
        parts = {"per_product": self._per_product, "products": self._profile, "held_out": self._test}
        if self.model_type in POOLED:
            parts["codes"] = self._codes
        if self.model_type == "random_forest":
            parts["trees"] = self._pipeline.table
        elif isinstance(self._pipeline, pooled.Line):
            parts["coefficients"] = self._pipeline.table
        return parts

    def save(self, path: str) -> None:
        """Everything that forecasts and metrics need, below one folder that must not exist yet.

        The manifest, with rows and checksum of every part, is written last: what a failed save leaves behind can't be loaded.
        """
        self._require_trained()
        spark = self._per_product.sparkSession
        sums = []
        for name, part in self._parts().items():
            seen = Observation()
            part.observe(seen, *_checksum(part)).write.parquet(f"{path}/{name}")
            sums.append((name, seen.get["rows"], seen.get["checksum"]))
        if isinstance(self._pipeline, PipelineModel):
            self._pipeline.write().save(f"{path}/pipeline")
        about = spark.createDataFrame(
            [(self.model_type, self.fit_on, self.trees, self.partitions, list(features.FEATURES), features.TARGET, sums)], ABOUT)
        about.coalesce(1).write.json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DemandModel:
        """A saved model; one that is incomplete, or whose parts differ from what was saved, is refused."""
        try:
            files.require_paths(spark, f"{path}/about/_SUCCESS")
        except ValueError as error:
            raise ValueError(f"incomplete model: {error}") from None
        about = spark.read.schema(ABOUT).json(f"{path}/about").first()
        loaded = cls(about.model_type, about.fit_on, about.trees, about.partitions)
        parts = {}
        for name, n_rows, checksum in about.parts:
            files.require_paths(spark, f"{path}/{name}")
            parts[name] = spark.read.parquet(f"{path}/{name}")
            found = parts[name].agg(*_checksum(parts[name])).first()
            if (found.rows, found.checksum) != (n_rows, checksum):
                raise ValueError(f"damaged model: {name} has {found.rows} rows and is not what was saved ({n_rows} rows)")
        loaded._per_product, loaded._profile, loaded._test = parts["per_product"], parts["products"], parts["held_out"]
        if loaded.model_type in POOLED:
            loaded._codes = parts["codes"]
        if loaded.model_type == "random_forest":
            loaded._pipeline = forest.Forest(parts["trees"], pooled.POOLED_FEATURES)
        elif "coefficients" in parts:
            loaded._pipeline = pooled.Line(parts["coefficients"], pooled.POOLED_FEATURES)
        elif loaded.model_type == "pooled_linear_regression":
            loaded._pipeline = PipelineModel.load(f"{path}/pipeline")
        return loaded


def reloaded(model: DemandModel, spark: SparkSession) -> DemandModel:
    """The model saved to the shared folder and loaded again."""
    path = shared_path(spark, f"{model.model_type}-model")
    model.save(path)
    return DemandModel.load(spark, path)


def trained_and_reloaded(spark: SparkSession, sales: DataFrame, model_type: str, **options: object) -> DemandModel:
    return reloaded(DemandModel(model_type, **options).train(sales), spark)

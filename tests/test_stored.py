"""Stored rows."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from ripecast.sources import files


def test_stored_rows_leave_no_shuffle_files(spark):
    """What is stored is read from there: the shuffles behind it would only hold disk until the driver collects its garbage."""
    folders = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled() -> set[str]:
        return {f for folder in folders for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}

    before = shuffled()
    rows = spark.range(5000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50))).repartition(3, "k").groupBy("k").agg(F.sum("id").alias("s"))
    stored = files.materialize(rows.repartition(5, "s"), "stored")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and stored.count() == 50
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

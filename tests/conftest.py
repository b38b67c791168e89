from __future__ import annotations

import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("plumbline-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g")
               # Small test tables must still be cut into several range partitions.
               .config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def make_series(spark):
    """Series of a numpy array, one value a day, cut into small blocks."""
    from plumbline.functions.series import build_series

    def make(block_rows: int = 64, **arrays):
        rows = [(k, i, float(v)) for k, a in arrays.items() for i, v in enumerate(a)]
        df = spark.createDataFrame(rows, "k string, i int, y double").withColumn("ts", F.timestamp_add(
            "DAY", F.col("i"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")))
        # Input order must not matter.
        return build_series(df.repartition(5, "y"), "ts", ["y"], ["k"], block_rows=block_rows)

    return make


@pytest.fixture(scope="session")
def noise():
    rng = np.random.default_rng(7)
    return {
        "step": np.r_[rng.normal(0, 1, 120), rng.normal(2, 1, 80)] + 100,
        "walk": np.cumsum(rng.normal(size=300)),
        "wave": np.sin(np.arange(250) / 9) + rng.normal(size=250) * 0.3,
        "short": rng.normal(size=31),
    }

import os
import sys
import tempfile

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("altigrid-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def to_cells(spark):
    """Array to cell table; NaN becomes NULL."""

    def make(grid: np.ndarray, scene: int = 0, name: str = "v"):
        r, c = np.mgrid[0 : grid.shape[0], 0 : grid.shape[1]]
        pdf = pd.DataFrame({"scene": np.int64(scene), "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), name: grid.ravel().astype("float64")})
        from altigrid.model import cut, finite

        df = spark.createDataFrame(pdf, f"scene bigint, row int, col int, {name} double")
        df = df.withColumn(name, finite(name))
        return cut(df) if grid.size > 50_000 else df

    return make


@pytest.fixture(scope="session")
def to_grid():
    def make(df, name: str = "v") -> np.ndarray:
        pdf = df.select("row", "col", name).toPandas()
        out = np.full((pdf["row"].max() + 1, pdf["col"].max() + 1), np.nan)
        out[pdf["row"], pdf["col"]] = pdf[name].astype(float)
        return out

    return make

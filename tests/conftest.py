from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from strayrow.session import ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="strayrow-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


def table(spark: SparkSession, matrix: np.ndarray, names=None, **more):
    """A table with the key ``id`` and one double column per matrix column."""
    names = names or [f"f{i}" for i in range(matrix.shape[1])]
    frame = pd.DataFrame(matrix, columns=names)
    frame.insert(0, "id", np.arange(len(frame)))
    for name, values in more.items():
        frame[name] = values
    return spark.createDataFrame(frame)


def by_id(df, column: str, key: str = "id") -> np.ndarray:
    rows = df.select(key, column).toPandas().sort_values(key)
    return rows[column].to_numpy()


@pytest.fixture(scope="session")
def bearings(spark):
    """222 rows of four quiet sensors."""
    rng = np.random.default_rng(7)
    centre = np.array([0.0609, 0.0756, 0.0798, 0.0441])
    spread = np.array([0.0008, 0.0008, 0.0016, 0.0005])
    matrix = centre + spread * rng.standard_normal((222, 4))
    return table(spark, matrix, [f"bearing{i}" for i in range(1, 5)])


@pytest.fixture(scope="session")
def planted(spark):
    """A cloud of 600 rows and 12 far points, marked by ``y``."""
    rng = np.random.default_rng(11)
    cloud = rng.standard_normal((600, 4))
    far = 9.0 * np.sign(rng.standard_normal((12, 4))) + rng.standard_normal((12, 4))
    y = np.r_[np.zeros(600, dtype=int), np.ones(12, dtype=int)]
    return table(spark, np.vstack([cloud, far]), y=y).persist()

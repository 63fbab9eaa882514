from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def spark_home(tmp_path_factory):
    """A local-cluster keeps its executors' folders in Spark's home and ends if it can't: there, links to that home serve."""
    from pyspark.find_spark_home import _find_spark_home

    home = _find_spark_home()
    work = os.path.join(home, "work")
    if os.access(work, os.W_OK | os.X_OK) if os.path.isdir(work) else not os.path.lexists(work) and os.access(home, os.W_OK):
        yield
        return
    (links := tmp_path_factory.mktemp("spark") / "home").mkdir()
    for name in set(os.listdir(home)) - {"work"}:
        os.symlink(os.path.join(home, name), links / name)
    with pytest.MonkeyPatch.context() as m:
        m.setenv("SPARK_HOME", str(links))
        yield


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import local_session

    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


def walk(n: int, seed: int, symbol: str = "A", start: str = "2020-01-01", vol: float = 0.02) -> pd.DataFrame:
    """Seeded random-walk bars with low <= open, close <= high."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0003, vol, n)))
    open_ = close * (1 + rng.normal(0, vol / 2, n))
    high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, vol / 2, n)))
    low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, vol / 2, n)))
    return pd.DataFrame({"symbol": symbol, "ts": pd.date_range(start, periods=n, freq="D"), "open": open_, "high": high, "low": low, "close": close,
                         "volume": rng.integers(1, 50, n).astype(float)})


@pytest.fixture(scope="session")
def walks() -> pd.DataFrame:
    return pd.concat([walk(300, 1, "A"), walk(220, 2, "B"), walk(37, 3, "C"), walk(9, 4, "D")], ignore_index=True)


def to_bars(spark, pdf: pd.DataFrame):
    from pyspark.sql import functions as F

    from tickloom.functions.series import index_bars

    return index_bars(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), chunk="month")


def collect(df, *keys: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("wh")))
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    yield s
    s.stop()


@pytest.fixture
def bars(spark):
    """Two symbols, one with 40 and one with 400 dated rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    frames = []
    for sym, n in ((1, 40), (2, 400)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        d = pd.bdate_range("2020-01-01", periods=n).date
        frames.append(pd.DataFrame({"symbol": sym, "date": d, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": rng.integers(1000, 9000, n).astype(float)}))
    pdf = pd.concat(frames)
    pdf["turnover"] = pdf.close * pdf.volume
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)), pdf

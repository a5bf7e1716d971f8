import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DAY0 = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def make_bars(spark):
    """Bars from ``(symbol, day, open, close[, signal])`` tuples."""

    def build(rows, start=DAY0):
        data = [
            (r[0], start + timedelta(days=r[1]), float(r[2]), float(r[3]), *(r[4:] or (0,))) for r in rows
        ]
        df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, close double, signal int")
        return df.withColumns(
            {
                "high": F.greatest("open", "close"),
                "low": F.least("open", "close"),
                "volume": F.lit(1000.0),
            }
        )

    return build

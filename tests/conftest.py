import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("latecast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cases(spark):
    """The edge rows: last report on a Wednesday, so weeks start on Thursday."""
    rows = [
        ("2020-06-01", "2020-06-02"), ("2020-06-03", "2020-06-10"), ("2020-06-05", "2020-06-04"),
        ("2020-06-09", "2020-06-17"), ("2020-06-10", "2020-06-10"), ("2020-06-12", "2020-06-01"),
        ("2020-06-16", "2020-06-17"), (None, "2020-06-12"), ("2020-06-15", None),
    ]
    return spark.createDataFrame(rows, "onset string, report string").selectExpr(
        "cast(onset as date) onset", "cast(report as date) report"
    )

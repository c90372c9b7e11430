import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def staff(spark):
    """Seven people: one missing age, one repeated row, dates as text."""
    rows = [
        (25, 50000, "Sales", "2020-01-15"),
        (30, 60000, "Engineering", "2019-03-20"),
        (45, 120000, "Sales", "2021-06-10"),
        (25, 50000, "Sales", "2020-01-15"),
        (50, 150000, "Engineering", "2018-11-05"),
        (60, 200000, "HR", "2022-02-01"),
        (None, 70000, "Sales", "2021-08-12"),
    ]
    return spark.createDataFrame(rows, "Age int, Salary bigint, Department string, HireDate string")


def by_column(df, key="column_name"):
    return {r[key]: r.asDict() for r in df.collect()}

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("lexweave-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def evaluate(spark):
    """The value of a column function over given values."""

    def run(expression, **values):
        types = {str: "string", int: "int", float: "double", list: "array<double>"}
        names = ", ".join(
            f"{name} {types.get(type(v), 'string')}" for name, v in values.items()
        )
        row = spark.createDataFrame([tuple(values.values())], names)
        columns = [F.col(name) for name in values]
        return row.select(expression(*columns).alias("out")).collect()[0]["out"]

    return run


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import SparkSession

from tidemart import tune
from tidemart.schemas import RAW_SCHEMAS

AS_OF = dt.date(2024, 12, 31)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Frame of a RAW table from rows given as dicts; absent columns are NULL."""

    def make(name: str, rows: list[dict]):
        schema = RAW_SCHEMAS[name]
        return spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in rows], schema)

    return make


def day(offset: int) -> dt.date:
    return AS_OF + dt.timedelta(days=int(offset))

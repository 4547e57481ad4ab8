"""A Spark session and small databases."""

from __future__ import annotations

import os
import sys
import warnings
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (str(Path(__file__).parents[1]), os.environ.get("PYTHONPATH")) if p)  # for Spark's Python workers

import relfeat  # noqa: E402
from helpers import day  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    made = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture
def shop(spark: SparkSession) -> relfeat.Database:
    """Three buyers, the third without orders; four orders; five lines. Orders 2 and 4 have no lines."""
    buyers = spark.createDataFrame([(1, 30, "north", day(1)), (2, 40, "south", day(2)), (3, 50, "north", day(3))], "id long, age long, area string, joined timestamp_ntz")
    orders = spark.createDataFrame([(1, 1, 10.0, True, day(4), None), (2, 1, 5.0, False, day(5), day(9)), (3, 2, 7.5, None, day(6), day(7)), (4, None, 99.0, True, day(6), None)], "id long, buyer_id long, amount double, paid boolean, placed timestamp_ntz, closed timestamp_ntz")
    lines = spark.createDataFrame([(1, 1, "a", 2, day(4)), (2, 1, "b", 3, day(5)), (3, 1, None, 4, day(6)), (4, 3, "a", 5, day(7)), (5, 3, "a", None, day(8))], "id long, order_id long, item string, quantity int, made timestamp_ntz")
    return (
        relfeat.Database("shop")
        .add_table("buyers", buyers, "id", "joined", categorical=["area"])
        .add_table("orders", orders, "id", "placed", where={"large": F.col("amount") >= 7, "never": F.col("amount") < 0}, when={"open": lambda cutoff: F.col("closed").isNull() | (F.col("closed") > F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz"))})
        .add_table("lines", lines, "id", "made")
        .add_relationship("buyers", "orders", "buyer_id")
        .add_relationship("orders", "lines", "order_id")
    )


@pytest.fixture(autouse=True)
def quiet() -> None:
    warnings.simplefilter("ignore", ResourceWarning)

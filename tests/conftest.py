from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["broadcast", "partly", "shuffle"])
def all_sizes(request, spark):
    """Run a test with small lookups broadcast, with only the smallest of them, and
    as if none would fit."""
    if request.param == "partly":
        spark.conf.set("spark.evalsieve.broadcastBytes", "20000")
    if request.param == "shuffle":
        spark.conf.set("spark.evalsieve.broadcastRows", "0")
        spark.conf.set("spark.evalsieve.keyRows", "3")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    for key in (
        "spark.evalsieve.broadcastRows",
        "spark.evalsieve.broadcastBytes",
        "spark.evalsieve.keyRows",
        "spark.sql.autoBroadcastJoinThreshold",
    ):
        spark.conf.unset(key)

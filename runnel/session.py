"""The Spark session that the library's tests, benchmark and examples use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "runnel", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Settings that are given win over these."""
    cores = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.master": master or f"local[{cores}]",
        "spark.app.name": name,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

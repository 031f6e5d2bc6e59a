"""A Spark session for the command line, tests and benchmarks; on a cluster, use the one it gives."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: int | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """The running session, or a new local one with adaptive execution and UTC."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.appName("corpuskin")
    if not os.environ.get("SPARK_REMOTE") and not os.environ.get("MASTER"):
        builder = builder.master(f"local[{n}]")
    conf = {
        "spark.sql.shuffle.partitions": str(partitions or n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.sql.files.maxPartitionBytes": "4m",
        "spark.sql.files.openCostInBytes": "256k",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""One place that builds the Spark session used by the bench, the tests and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "kinfold", cpus: int | str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on. On a cluster the master comes from spark-submit;
    only without one does it fall back to ``local[cpus]``."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

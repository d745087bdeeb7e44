"""Session set-up shared by tests, the benchmark and command-line use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cpus: int | str | None = None, app: str = "corpusmill", memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the operators are written for (AQE on, UTC)."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

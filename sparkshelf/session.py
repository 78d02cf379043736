"""Session factory: UTC, adaptive execution, whole results."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "sparkshelf", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session to the operators instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

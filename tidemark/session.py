"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", app: str = "tidemark") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass SETTINGS to your own builder."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

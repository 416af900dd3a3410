"""Session settings that the jobs count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "12g", **settings: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own sizes."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("railweave").config(
        "spark.driver.memory", memory).config("spark.ui.enabled", "false").config(
        "spark.sql.shuffle.partitions", str(cores))
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session

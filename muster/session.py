"""Session settings for tests, the bench and single-machine use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", *, app: str = "muster", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session. On a cluster, bring your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

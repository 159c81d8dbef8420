"""A session with the settings that the library's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "geomlake", **more: str) -> SparkSession:
    """UTC, adaptive plans with skew joins and merged partitions; `more` sets dotted keys written with __."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

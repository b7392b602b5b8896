"""The Spark session's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lakeloom", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skew handling; ``conf`` overrides (dots as double underscores)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.groupByAliases": "true",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()

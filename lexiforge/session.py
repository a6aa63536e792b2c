"""Sessions with the settings that the engine's results are defined under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lexiforge", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **settings,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

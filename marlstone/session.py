"""A Spark session with the settings the operators are tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; other settings are the cluster's, or given as keywords with _ for a dot."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()

"""A session with the settings this package is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

# All of them are Spark's own; none changes a result.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A plan is printed with its expressions whole.
    "spark.sql.debug.maxToStringFields": "100",
}


def builder(app: str = "tagloom") -> SparkSession.Builder:
    made = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    return made

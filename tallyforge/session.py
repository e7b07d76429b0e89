"""Session settings that the library's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyforge", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is the cluster's to set."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()

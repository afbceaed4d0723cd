"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "modewave", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` (underscores for dots) goes on top."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()

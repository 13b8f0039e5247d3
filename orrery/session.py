"""A session with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "orrery", **conf: str) -> SparkSession:
    """UTC, adaptive execution; whatever the cluster sets otherwise stays."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master or "SPARK_MASTER" in os.environ:
        b = b.master(master or os.environ["SPARK_MASTER"])
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()

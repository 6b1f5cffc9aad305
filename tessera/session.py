"""A session with the settings that the library is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """The active session, or a new one. Adaptive execution sizes partitions and splits skewed joins at run time."""
    b = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        b = b.config(k, v)
    if os.environ.get("SPARK_MASTER"):
        b = b.master(os.environ["SPARK_MASTER"])
    return b.getOrCreate()

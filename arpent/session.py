"""Session factory and the settings the engine relies on."""
from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "arpent", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides or adds settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Session defaults of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "newsloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings every plan of this package assumes.

    AQE coalesces small shuffle partitions, splits skewed ones and turns a join
    into a broadcast only after it has measured the side's size.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

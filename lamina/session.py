"""Session factory for applications and tests; operators accept any session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app_name: str = "lamina", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session. Sizing (partitions, memory, checkpoint folder) belongs to the cluster.

    Extra keyword settings use ``__`` for dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # plans are built from many small expressions; do not record a Python stack for each
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

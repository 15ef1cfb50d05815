"""One place that makes Spark sessions, for tests, benches and jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "folioscope", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings the library counts on: UTC and adaptive execution.

    Settings in ``conf`` (dots written as double underscores) win over the defaults. On a
    cluster the master comes from spark-submit, and ``cpus`` is unused.
    """
    builder = SparkSession.builder.appName(app)
    if "MASTER" not in os.environ and "PYSPARK_SUBMIT_ARGS" not in os.environ:
        builder = builder.master(f"local[{cpus}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

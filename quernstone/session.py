"""Session settings that the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "quernstone", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings by keyword, dots as ``__``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master or os.environ.get("BENCH_CPUS"):
        builder = builder.master(master or f"local[{os.environ['BENCH_CPUS']}]")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

"""Session defaults for local use; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and shuffle partitions for ``cores`` local threads."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()

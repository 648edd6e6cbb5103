"""A local session for tests, benches and comparisons; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(name: str, cores: str | None = None) -> SparkSession:
    """AQE on, few shuffle partitions, UTC; checkpoints in a local folder, as this session is local."""
    spark = (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tidende-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

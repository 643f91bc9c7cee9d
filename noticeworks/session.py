"""Session settings for local runs; on a cluster the submitter's settings win."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local[...] session for tests and the bench; never used on a cluster."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("noticeworks")
    settings = LOCAL_SETTINGS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.checkpoint.dir": os.path.join(tempfile.gettempdir(), f"noticeworks-{os.getpid()}"),
    } | extra
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

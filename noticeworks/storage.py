"""Tables in, intermediate tables out.

Intermediates go to the shared folder that the cluster names in
``spark.checkpoint.dir``; a machine-local folder is only chosen in local mode
when that setting is absent.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_spooled: list[str] = []


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    # Spark 4.1 zips the parts of a union that are partitioned alike, and fails where adaptive execution gave them different numbers of partitions.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; set here only in local mode without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"noticeworks-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def remember(path: str) -> str:
    """Notes a written table for ``release`` and gives its path back."""
    _spooled.append(path)
    return path


def spool(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage without a copy that lives on one executor only: the files
    outlive any executor. Column-wise and compressed, so smaller than a
    checkpoint of rows.
    """
    path = remember(f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}.parquet")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores, for work in Python over few or small files.

    A table read in enough splits is left as it is, so nothing is shuffled at scale.
    For frames that come from a scan: asking a frame behind a shuffle for its
    partitions would run the shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> int:
    """Deletes the tables this process has spooled; call it once their results are written. Returns their number."""
    n = len(_spooled)
    for path in _spooled:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _spooled.clear()
    return n

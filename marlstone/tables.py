"""Access to tables, and tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Where it is unset, a temporary folder serves, but only for a local master: on a cluster an executor
    could not read another machine's folder, so that raises ValueError.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="marlstone-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir() or where
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended; the shared folder is the cluster's to clean
        pass


_WRITTEN: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Removes all tables written so far: for a long session between queries whose results have been taken."""
    while _WRITTEN:
        _remove(*_WRITTEN.pop())


atexit.register(release)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and not lost with an executor.

    The table is removed when the driver's process ends, or by `release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over at least as many partitions as there are cores, for work that is heavy for its bytes.

    Only an input with fewer partitions than cores is shuffled, so a large one never is. For scans with projections
    and filters; anything that shuffles would be run by counting its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

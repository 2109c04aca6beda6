"""Requests as a stream: deliveries counted once, open slots by window of issue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.operators.queue import unfilled


def request_stream(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 16) -> DataFrame:
    """Request rows as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def first_deliveries(requests: DataFrame, late: str = "30 days") -> DataFrame:
    """Each (file, id) once: rows delivered again within the delay are dropped, and state older than it is forgotten.

    Rows without issued_at cannot be placed in time; they are no part of it, but of `untimed`.
    """
    timed = requests.filter("issued_at is not null").withColumn("issued_at", F.col("issued_at").cast("timestamp"))
    return timed.withWatermark("issued_at", late).dropDuplicatesWithinWatermark(["file", "id"])


def untimed(requests: DataFrame) -> DataFrame:
    """The rows that the windows cannot place, those without issued_at: a stream of its own, so that none is lost."""
    return requests.filter("issued_at is null")


def open_by_window(requests: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """(window, n_requests, n_open) by time of issue; a window is final once it is older than the delay."""
    waits = unfilled(F.col("def"), F.col("blocks"))
    timed = requests.filter("issued_at is not null").withColumn("issued_at", F.col("issued_at").cast("timestamp")).withWatermark("issued_at", late)
    return timed.groupBy(F.window("issued_at", window)).agg(F.count("*").alias("n_requests"), F.count_if(waits).alias("n_open"))

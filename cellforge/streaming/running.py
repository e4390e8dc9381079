"""The shape log as a stream: repeated records dropped and counts kept per class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files under ``path`` as they come."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("emitted_at", F.col("emitted_at").cast("timestamp"))


def first_of_each(log: DataFrame, late: str = "6 hours") -> DataFrame:
    """Each (export, mask) once within the time that late rows are waited for; the state is dropped behind the watermark."""
    known = log.where("dataset_id is not null and cells is not null")
    return known.withWatermark("emitted_at", late).dropDuplicatesWithinWatermark(["dataset_id", "cells"])


def windowed_counts(log: DataFrame, window: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """Per window of emission, longest side and class: rows, and the sum of sizes. In append mode a window comes out once it is closed."""
    timed = log.withWatermark("emitted_at", late)
    grouped = timed.groupBy(F.window("emitted_at", window).alias("w"), "max_dimension", "has_hole").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("sum_size"))
    return grouped.select(F.col("w.start").alias("window_start"), "max_dimension", "has_hole", "n_rows", "sum_size")

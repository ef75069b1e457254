"""The evaluation's counts over a growing folder: an addition, the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspectra.operators.metrics import contingency, valid

SCHEMA = "image_id int, r int, c int, target int, pred int"


def pixel_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Running counts of (pred, target) over Parquet files as they arrive; state is one row for each pair."""
    return contingency(valid(spark.readStream.schema(SCHEMA).parquet(folder)))

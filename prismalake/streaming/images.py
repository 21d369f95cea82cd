"""Image operators over a growing folder. They work row by row, so they run on streams unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PLANES = "image_id long, height int, width int, channels int, data array<double>"


def stream_planes(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Plane rows of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(PLANES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def start(planes: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply an operator to all files there are and write the results, each file once."""
    return operator(planes).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Raw change events as a table and as a replayable stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from worklens import schemas


def read_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.RAW_EVENT).format(fmt).load(path)


def stream_events(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """The append log as a stream; files are replayed from the checkpoint after a loss."""
    reader = spark.readStream.schema(schemas.RAW_EVENT).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)

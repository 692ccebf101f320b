"""Streaming of the orebed engine: an optional ingest of files as assets.

The catalog itself has no streams; each micro-batch is an ordinary import.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files below a folder as (locator, data, seq); seq is the time of change in microseconds."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("locator"), F.col("content").alias("data"), F.unix_micros("modificationTime").alias("seq"))


def ingest(assets: DataFrame, workspace, checkpoint: str):
    """Imports every micro-batch; a repeated batch adds nothing, as inserts go by identity."""

    def write(batch: DataFrame, _: int) -> None:
        from ..operators import catalog

        workspace.insert(catalog.import_rows(batch.persist(), workspace.namespace))

    return assets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""New snapshot files into a Parquet table of captures, each capture once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import schema


def capture_stream(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Captures from JSON files as they arrive, repeats within the delay dropped."""
    rows = spark.readStream.schema(schema()).json(folder).where("analysisId is not null and capturedAt is not null")
    return rows.withWatermark("capturedAt", delay).dropDuplicatesWithinWatermark(["analysisId", "url", "viewport"])


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to the table's folder and stops."""
    return capture_stream(spark, folder).drop("_corrupt_record").writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

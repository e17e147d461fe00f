"""Logs that arrive as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchengine.sources import logs


def stream_lines(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """Lines of files as they appear under ``path``; a file is one record."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def ingest(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, DataFrame, int], None]):
    """Parse each micro-batch to levels and gammas and hand them to ``sink``
    with the batch number; files are never split over batches."""

    def each(batch: DataFrame, number: int) -> None:
        numbered = logs.number_levels(logs.parse_records(logs.carry_forward(batch)))
        sink(logs.levels(numbered), logs.gammas(numbered), number)

    return stream_lines(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; late ones count up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

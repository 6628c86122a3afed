"""Captures that arrive while a stream runs: indexed once each, into the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandweave.sources.captures import index


def ingest(spark: SparkSession, folder: str, cache: str, checkpoint: str, pattern: str = "*.{m2t,ts,m2ts,mts,mpg,mpeg}", available_now: bool = True) -> StreamingQuery:
    """Index new captures of a folder as they come.

    The file source keeps track of what it has seen (exactly once, in the checkpoint);
    only paths pass through the stream, never the bytes, and each micro-batch scans
    what the cache does not have, so a batch that runs again does no harm.
    """
    files = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(files).option("pathGlobFilter", pattern).load(folder).select("path", "length")

    def add(batch: DataFrame, _: int) -> None:
        paths = [r["path"].removeprefix("file://").removeprefix("file:") for r in batch.select("path").distinct().collect()]
        if paths:
            index(spark, paths, cache)

    writer = found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def duplicate_events(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """A stream without rows whose key was seen within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def damage_counts(stream: DataFrame, at: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Damaged units per capture and time window, final once the watermark has passed the window."""
    bad = (F.col("cc") > 0) | (F.col("tei") > 0) | (F.col("dec") > 0)
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "capture").agg(F.count("*").alias("units"), F.count_if(bad).alias("damaged"))

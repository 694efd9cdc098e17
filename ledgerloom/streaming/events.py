"""The stateless tests and windowed counts over streams. Batch tables run through the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, stamp: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, key, n, total) by tumbling or sliding windows; later than ``late`` events are left out of a stream."""
    w = F.window(stamp, width, slide) if slide else F.window(stamp, width)
    out = events.withWatermark(stamp, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, stamp: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, start, end, n) of runs of events with no gap of ``gap`` or more."""
    out = events.withWatermark(stamp, late).groupBy(F.session_window(stamp, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, stamp: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def run_to_end(spark: SparkSession, stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, to files, and read them."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest(spark: SparkSession, stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Run an aggregated stream over what is there and read its whole last state, with the windows that are still open."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

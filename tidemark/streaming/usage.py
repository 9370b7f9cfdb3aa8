"""Usage as a stream: calls counted once, by kind and hour, while they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_usage(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """(kind, hour, calls) of a stream of calls (call_id, kind, at): each call once, however often it is delivered within
    `late`; an hour is given out when nothing of it is waited for any more. Calls later than that, and those without
    an instant, are left out.
    """
    once = calls.withWatermark("at", late).dropDuplicatesWithinWatermark(["call_id"])
    hours = once.groupBy("kind", F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("calls"))
    return hours.select("kind", F.col("w.start").alias("hour"), "calls")


def write(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to Parquet files, and goes on from the checkpoint when started again."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

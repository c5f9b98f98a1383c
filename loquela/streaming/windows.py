"""Streams of segments: tumbling counts with a watermark, and duplicates within a time bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquela.operators.chunks import scene_type


def chunk_counts(segments: DataFrame, minutes: int = 10, late: str = "5 minutes") -> DataFrame:
    """(session, chunk_start, chunk_end, n, speakers) of event-time windows over a stream with `ts`.

    State is one row for each session and open window; windows close behind the watermark.
    """
    w = F.window("ts", f"{minutes} minutes")
    counted = segments.withWatermark("ts", late).groupBy("session", w).agg(F.count("*").alias("n"), F.approx_count_distinct("speaker").alias("speakers"))
    return counted.select("session", F.col("window.start").alias("chunk_start"), F.col("window.end").alias("chunk_end"), "n", "speakers")


def chunk_scenes(segments: DataFrame, minutes: int = 10, late: str = "5 minutes") -> DataFrame:
    """The scene class of each closed window, from its texts in time order."""
    rows = segments.withWatermark("ts", late).groupBy("session", F.window("ts", f"{minutes} minutes")).agg(F.array_sort(F.collect_list(F.struct("ts", "text"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    return rows.select("session", F.col("window.start").alias("chunk_start"), scene_type(text).alias("scene_type"))


def first_mentions(segments: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Drops rows whose normal text the session has had within the watermark, from whatever source."""
    keyed = segments.withColumn("_t", F.lower(F.trim("text"))).withWatermark("ts", late)
    return keyed.dropDuplicatesWithinWatermark(["session", "_t"]).drop("_t")

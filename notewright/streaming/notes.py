"""Dictionary spans of notes that arrive as a stream: stateless per note, so the batch plan's parts run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def keyed_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """A stream of notes with their match key."""
    return stream.withColumn("key", X.norm_key(F.col(text)))


def counts(stream: DataFrame, at: str, by: str, late: str = "7 days", window: str = "1 day") -> DataFrame:
    """Notes per window and group, late ones taken up to the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), F.col(by)).agg(F.count("*").alias("n"))

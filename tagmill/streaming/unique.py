"""Streaming unique-barcode counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_reads(stream: DataFrame, keys: list[str], umi: str = "umi", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The first read of each (keys, barcode) within the watermark: bounded state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, umi])


def windowed_counts(stream: DataFrame, keys: list[str], umi: str = "umi", time: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Reads and approximate distinct barcodes of each group and window."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("reads"), F.approx_count_distinct(umi).alias("umis"))

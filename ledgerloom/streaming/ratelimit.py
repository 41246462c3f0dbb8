"""Calls per caller and period, as a batch or a watermarked stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import ref


def over_limit(df: DataFrame, key: str, at: str, period: str, limit: int) -> DataFrame:
    """Windows (``minute``, ``day``...) in which a key made more than ``limit`` calls."""
    counts = df.groupBy(ref(key), F.date_trunc(period, ref(at)).alias("period_start")).agg(
        F.count(F.lit(1)).alias("calls")
    )
    return counts.where(F.col("calls") > limit)


def over_limit_stream(
    stream: DataFrame, key: str, at: str, period: str = "1 minute", limit: int = 100, lateness: str = "10 minutes"
) -> DataFrame:
    """Streaming form; windows close once the watermark passes them. ``at`` must be a TIMESTAMP."""
    counts = (
        stream.withWatermark(at, lateness)
        .groupBy(F.window(ref(at), period), ref(key))
        .agg(F.count(F.lit(1)).alias("calls"))
    )
    return counts.where(F.col("calls") > limit).select(ref(key), F.col("window.start").alias("period_start"), "calls")

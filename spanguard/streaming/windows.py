"""Event-time windows; the same expressions serve batch tables and streams with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(ts, watermark) if watermark and df.isStreaming else df


def _flat(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keep)


def tumbling(df: DataFrame, by: list[str], size: str, ts: str = "ts", watermark: str | None = "10 minutes") -> DataFrame:
    """n and sum_value per window and key."""
    out = _late(df, ts, watermark).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value"))
    return _flat(out, [*by, "n", "sum_value"])


def sliding(df: DataFrame, by: list[str], size: str, slide: str, ts: str = "ts", watermark: str | None = "10 minutes") -> DataFrame:
    out = _late(df, ts, watermark).groupBy(F.window(ts, size, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return _flat(out, [*by, "n"])


def sessions(df: DataFrame, by: list[str], gap: str, ts: str = "ts", watermark: str | None = "10 minutes") -> DataFrame:
    """n per run of events of a key without a gap of that length; the end is the last event and the gap."""
    out = _late(df, ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return _flat(out, [*by, "n"])

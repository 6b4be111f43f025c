"""Event-time windows over streams of events, with watermarks for late rows; each works on batch input too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _late(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """Watermarks need an instant; times without a zone are read in the session's zone, best UTC."""
    if not (delay and df.isStreaming):
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _agg(value: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")]


def tumbling(df: DataFrame, ts: str, value: str, size: str, keys: tuple[str, ...] = (), delay: str | None = None) -> DataFrame:
    """(start, end, keys, n, total, most) of adjacent windows; rows later than ``delay`` are dropped by the watermark."""
    return _flat(_late(df, ts, delay).groupBy(F.window(ts, size).alias("w"), *keys).agg(*_agg(value)), keys, df.schema[ts].dataType)


def sliding(df: DataFrame, ts: str, value: str, size: str, slide: str, keys: tuple[str, ...] = (), delay: str | None = None) -> DataFrame:
    """The same for overlapping windows."""
    return _flat(_late(df, ts, delay).groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(*_agg(value)), keys, df.schema[ts].dataType)


def sessions(df: DataFrame, ts: str, value: str, gap: str, keys: tuple[str, ...] = (), delay: str | None = None) -> DataFrame:
    """The same for sessions that end after ``gap`` without a row."""
    return _flat(_late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*_agg(value)), keys, df.schema[ts].dataType)


def _flat(df: DataFrame, keys, kind) -> DataFrame:
    return df.select(F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), *keys, "n", "total", "most")

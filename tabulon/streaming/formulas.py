"""Formulas over streams: row formulas are plain projections, totals run per event-time window behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.table import Table


def project(stream: DataFrame, **formulas: str) -> DataFrame:
    """Row formulas as new columns; batch or streaming alike."""
    t = Table(stream)
    for name, formula in formulas.items():
        t = t.with_formula(name, formula)
    return t.df


def _watermarked(stream: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark, which needs a timestamp with a time zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(stream: DataFrame, time: str, keys: list[str], window: str, late: str, slide: str | None = None, **formulas: str) -> DataFrame:
    """Aggregate formulas per window and keys; rows later than ``late`` are dropped and windows close by it."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    t = Table(_watermarked(stream, time, late).withColumn("window", span))
    return t.group(["window", *keys], **formulas)


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str, **formulas: str) -> DataFrame:
    """Aggregate formulas per session of keys, which ends after a gap."""
    span = F.session_window(time, gap)
    t = Table(_watermarked(stream, time, late).withColumn("session_window", span))
    return t.group(["session_window", *keys], **formulas)

"""Contingency counts over a stream of labelled pixels: an extension, with the batch operator's plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_contingency(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of (gt, pred) for each key so far; run it in update or complete mode."""
    return pixels.groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n"))


def windowed_contingency(pixels: DataFrame, keys: list[str], time: str, window: str, late: str) -> DataFrame:
    """Counts for each key and time window; rows later than ``late`` are dropped and the state
    of closed windows goes, so it can run in append mode for ever."""
    return pixels.withWatermark(time, late).groupBy(F.window(time, window), *keys, "gt", "pred").agg(F.count("*").alias("n"))

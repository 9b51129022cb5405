"""Aggregates over tiles of time: what tiling and aggregation are for positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate_tiles(events: DataFrame, size: str, value: str = "value", time: str = "ts", late: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum, mean, least, most and number of value for each tile of time; for a stream late bounds the state by a watermark."""
    if late:
        events = events.withWatermark(time, late)
    tiles = events.groupBy(F.window(time, size), *by).agg(F.sum(value).alias("agg_sum"), F.avg(value).alias("agg_mean"), F.min(value).alias("agg_min"), F.max(value).alias("agg_max"), F.count(value).alias("agg_count"))
    return tiles.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "agg_sum", "agg_mean", "agg_min", "agg_max", "agg_count")

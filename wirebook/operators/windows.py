"""Tumbling and sliding windows over a feed of device measurements.

The feed has ip, a time, protocol, packet_count and avg_interval_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TUMBLING = "300 seconds"
SLIDING = "1800 seconds"
SLIDE = "300 seconds"
SPREAD_LIMIT = 0.2


def _time(feed: DataFrame, name: str) -> Column:
    # Epoch seconds become timestamps; a timestamp is left alone, because a
    # cast would lose the watermark of a stream.
    is_time = isinstance(feed.schema[name].dataType, T.TimestampType)
    return F.col(name) if is_time else F.col(name).cast("timestamp")


def tumbling_window(feed: DataFrame, timestamp_col: str = "ts") -> DataFrame:
    """Totals per device and five minutes.

    A stream cannot count distinct values exactly; there the set of protocols,
    which is small, is collected and measured instead.
    """
    protocols = F.size(F.collect_set("protocol")) if feed.isStreaming else F.count_distinct("protocol")
    return (
        feed.groupBy("ip", F.window(_time(feed, timestamp_col), TUMBLING))
        .agg(
            F.sum("packet_count").alias("total_packets"),
            F.avg("avg_interval_ms").alias("mean_interval_ms"),
            protocols.cast("bigint").alias("protocol_count"),
        )
        .select(
            "ip",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "total_packets",
            "mean_interval_ms",
            "protocol_count",
        )
    )


def sliding_window(feed: DataFrame, timestamp_col: str = "ts") -> DataFrame:
    """Totals and spread per device and half hour, every five minutes."""
    mean, std = F.col("mean_interval_ms"), F.col("std_interval_ms")
    spread = F.try_divide(std, mean) > SPREAD_LIMIT
    return (
        feed.groupBy("ip", F.window(_time(feed, timestamp_col), SLIDING, SLIDE))
        .agg(
            F.sum("packet_count").alias("total_packets"),
            F.avg("avg_interval_ms").alias("mean_interval_ms"),
            F.stddev_samp("avg_interval_ms").alias("std_interval_ms"),
        )
        .select(
            "ip",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "total_packets",
            "mean_interval_ms",
            "std_interval_ms",
            F.coalesce(std.isNotNull() & (mean > 0) & spread, F.lit(False)).alias("anomaly_candidate"),
        )
    )

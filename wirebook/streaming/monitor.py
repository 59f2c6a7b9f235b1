"""Stateful streams: running edges, alerts, silence and rolling windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirebook import catalog
from wirebook.operators.coverage import threshold_for_role
from wirebook.operators.detect import cutoff
from wirebook.operators.fold import interval_columns
from wirebook.operators.windows import sliding_window, tumbling_window
from wirebook.schemas import BASELINE_FEED, EDGE_KEY


def _keys() -> list[Column]:
    return [
        F.col("orig_h").alias("src_ip"),
        F.col("resp_h").alias("dst_ip"),
        F.col("protocol"),
        F.col("port"),
        F.col("function_code"),
    ]


def running_edges(comm: DataFrame) -> DataFrame:
    """Edges kept as streaming state; write in update mode."""
    folded = comm.groupBy(*_keys()).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("packet_count")
    )
    return folded.select(*EDGE_KEY, "first_seen", "last_seen", "packet_count", *interval_columns())


def new_edge_alerts(comm: DataFrame, baseline_end: datetime | Column, known: DataFrame | None = None) -> DataFrame:
    """Edges with their earliest time, and whether that is after the baseline; write in update mode.

    The earliest time of every key is state, so a key seen before the cutoff is
    no alert, whenever it comes back; one whose earlier rows come late turns
    from new to not new.  With ``known`` its keys are left out, and only rows
    after the cutoff need state.
    """
    return _first_seen(comm.select(*_keys(), F.col("ts").alias("seen_at")), EDGE_KEY, baseline_end, known)


def new_device_alerts(comm: DataFrame, baseline_end: datetime | Column, known: DataFrame | None = None) -> DataFrame:
    """Devices that are first seen after the baseline, as for edges."""
    seen = comm.select(F.explode(F.array_distinct(F.array("orig_h", "resp_h"))).alias("ip"), F.col("ts").alias("seen_at"))
    return _first_seen(seen, ["ip"], baseline_end, known)


def _first_seen(seen: DataFrame, keys: list[str], baseline_end: datetime | Column, known: DataFrame | None) -> DataFrame:
    after = F.col("seen_at") > cutoff(baseline_end)
    if known is not None:
        seen = seen.where(after)
    first = seen.groupBy(*keys).agg(F.min("seen_at").alias("seen_at"))
    first = first.withColumn("is_new", after)
    return first if known is None else _unknown(first, known, keys)


def _unknown(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    marked = known.select(*[F.col(k).alias(f"known_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        match = rows[k].eqNullSafe(marked[f"known_{k}"])
        same = match if same is None else same & match
    return rows.join(marked, same, "left_anti")


def silence_alerts(
    comm: DataFrame,
    roles: DataFrame | None = None,
    default_seconds: float = catalog.SILENCE_DEFAULT_SECONDS,
    role_seconds: dict[str, float] | None = None,
) -> DataFrame:
    """A row per sender once it has been quiet for its threshold.

    A session whose gap is the threshold of the device's role ends exactly
    when the device has been silent for that long; the watermark closes it.
    Sessions are merged before the shuffle, so a busy sender stays small.
    Write in append mode; ``comm`` needs a watermark.
    """
    rows = comm.select(F.col("orig_h").alias("ip"), "ts")
    if roles is not None:
        rows = rows.join(roles.select("ip", "role"), "ip", "left")
    else:
        rows = rows.withColumn("role", F.lit(None).cast("string"))
    rows = rows.withColumn("threshold_s", threshold_for_role(F.col("role"), default_seconds, role_seconds))
    gap = F.concat(F.col("threshold_s").cast("bigint").cast("string"), F.lit(" seconds"))
    sessions = rows.groupBy("ip", "role", "threshold_s", F.session_window("ts", gap).alias("session")).agg(
        F.max("ts").alias("last_seen"), F.count("*").alias("packets")
    )
    return sessions.select(
        "ip",
        "role",
        "last_seen",
        F.col("session.end").alias("silent_at"),
        "threshold_s",
        "packets",
    )


def parse_feed(raw: DataFrame) -> DataFrame:
    """JSON values of a feed topic to device measurements."""
    return raw.select(F.from_json(F.col("value").cast("string"), BASELINE_FEED).alias("d")).select("d.*")


def rolling_baseline(feed: DataFrame, window: str = "sliding", delay: str = "10 minutes") -> DataFrame:
    """Windows over a feed stream; late rows beyond the delay are dropped."""
    timed = feed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return sliding_window(timed) if window == "sliding" else tumbling_window(timed)


def start_baseline(
    windowed: DataFrame,
    path: str | None,
    checkpoint: str,
    trigger_seconds: int = 300,
    available_now: bool = False,
    fmt: str = "parquet",
    query_name: str | None = None,
) -> StreamingQuery:
    """Write closed windows to files, or running ones to a named memory table."""
    writer = windowed.writeStream.option("checkpointLocation", checkpoint).format(fmt)
    if fmt == "memory":
        writer = writer.queryName(query_name).outputMode("update")
    else:
        writer = writer.outputMode("append").option("path", path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()

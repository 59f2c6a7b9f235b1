"""Folding communications into edge and device tables.

Per edge the fold needs a minimum, a maximum and a count, all of which combine
in any order.  One hash aggregation with map-side partials therefore does the
work of an upsert per event, and a channel that holds a third of all events
still reaches the shuffle as one row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.schemas import EDGE_KEY

EVENT_TIME = "event_time"
ARRIVAL = "arrival"


def _first(mode: str) -> list[Column]:
    if mode == EVENT_TIME:
        return [F.min("first_seen").alias("first_seen")]
    if mode == ARRIVAL:
        return [
            F.min_by("first_seen", "first_seq").alias("first_seen"),
            F.min("first_seq").alias("first_seq"),
        ]
    raise ValueError(f"unknown mode {mode!r}")


def interval_columns() -> list[Column]:
    """Mean gap between packets of an edge, and whether it is a poll."""
    span_us = F.unix_micros("last_seen") - F.unix_micros("first_seen")
    mean = F.when(
        F.col("packet_count") > 1, F.try_divide(span_us / F.lit(1000.0), (F.col("packet_count") - 1).cast("double"))
    ).otherwise(0.0)
    periodic = (F.col("packet_count") > 1) & mean.between(catalog.PERIODIC_MIN_MS, catalog.PERIODIC_MAX_MS)
    return [mean.alias("avg_interval_ms"), periodic.alias("is_periodic")]


def _fold(parts: DataFrame, mode: str) -> DataFrame:
    folded = parts.groupBy(*EDGE_KEY).agg(
        *_first(mode), F.max("last_seen").alias("last_seen"), F.sum("packet_count").alias("packet_count")
    )
    return folded.select(
        *EDGE_KEY,
        "first_seen",
        "last_seen",
        "packet_count",
        *interval_columns(),
        *(["first_seq"] if mode == ARRIVAL else []),
    )


def fold_edges(comm: DataFrame, mode: str = EVENT_TIME) -> DataFrame:
    """Communications to edges.

    ``event_time`` takes the earliest timestamp as ``first_seen``, so that the
    order of processing does not matter.  ``arrival`` takes the timestamp of
    the event that arrived first, by ``ingest_seq``.
    """
    parts = comm.select(
        F.col("orig_h").alias("src_ip"),
        F.col("resp_h").alias("dst_ip"),
        "protocol",
        "port",
        "function_code",
        F.col("ts").alias("first_seen"),
        F.col("ts").alias("last_seen"),
        F.lit(1).cast("bigint").alias("packet_count"),
        *([F.col("ingest_seq").alias("first_seq")] if mode == ARRIVAL else []),
    )
    return _fold(parts, mode)


def merge_edges(*tables: DataFrame, mode: str = EVENT_TIME) -> DataFrame:
    """Combine edge tables folded from disjoint sets of events."""
    keep = [*EDGE_KEY, "first_seen", "last_seen", "packet_count"] + (["first_seq"] if mode == ARRIVAL else [])
    return _fold(reduce(DataFrame.unionByName, [t.select(*keep) for t in tables]), mode)


def fold_devices(edges: DataFrame, inventory: DataFrame | None = None, mode: str = EVENT_TIME) -> DataFrame:
    """Devices out of edges: a device is seen when one of its edges is.

    Working from edges instead of events means the events are read and
    shuffled once.  ``inventory`` (ip and any of mac, role, purdue_level)
    fills in what traffic alone does not tell.
    """
    order = ["first_seq"] if mode == ARRIVAL else []
    ends = edges.select(
        F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ip"), "first_seen", "last_seen", *order
    )
    seen = ends.groupBy("ip").agg(*_first(mode), F.max("last_seen").alias("last_seen")).drop(*order)
    known = {"mac": "string", "role": "string", "purdue_level": "int"}
    have = [] if inventory is None else [c for c in known if c in inventory.columns]
    if have:
        seen = seen.join(inventory.select("ip", *have), "ip", "left")
    return seen.select(
        "ip",
        *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in known.items()],
        "first_seen",
        "last_seen",
        F.lit(None).cast("int").alias("inferred_purdue_level"),
        F.lit(None).cast("double").alias("role_confidence"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Outbound and inbound edges per device; a self edge counts in both."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src_ip").alias("ip"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst_ip").alias("ip"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    )
    return ends.groupBy(F.col("e.ip").alias("ip")).agg(
        F.sum("e.o").alias("out_edges"), F.sum("e.i").alias("in_edges")
    )

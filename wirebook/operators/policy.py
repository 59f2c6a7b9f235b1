"""Set-valued policy forms of the detections, and user-supplied rules."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.operators import detect
from wirebook.operators.extensions import DEFAULT, Registry
from wirebook.schemas import EDGE_KEY


def different(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The different ones of rows that hold their edge's key and differ where the key does not.

    Where the table has each key once, as a fold leaves it, all of them are
    different: to know that, hashes of the keys cross a shuffle, once for all
    policies of a plan.  Only where a key (or a hash) comes twice do the rows
    themselves.  The edges are read for both cases, so they had better be
    stored.
    """
    key = F.xxhash64(*EDGE_KEY, *[F.col(c).isNull() for c in EDGE_KEY])  # hashes pass over nulls
    hashes = edges.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    repeated = hashes.where("n > 1").agg(F.count("*")).scalar()
    return rows.where(repeated == 0).unionAll(rows.where(repeated > 0).distinct())


def cross_zone(edges: DataFrame, device_zone: DataFrame, zones: DataFrame) -> DataFrame:
    found = detect.cross_zone_violations(edges, device_zone, zones, ordered=False)
    return found.withColumn("level_diff", F.abs(F.col("src_level") - F.col("dst_level"))).distinct()


def new_device(devices: DataFrame, baseline_end: datetime | Column) -> DataFrame:
    return detect.new_devices(devices, baseline_end, ordered=False).distinct()


def new_edge(edges: DataFrame, baseline_end: datetime | Column) -> DataFrame:
    return different(detect.new_edges(edges, baseline_end, ordered=False), edges)


def interval_deviation(
    edges: DataFrame, min_ms: float = catalog.PERIODIC_MIN_MS, max_ms: float = catalog.PERIODIC_MAX_MS
) -> DataFrame:
    """Deviating edges with the bound they break; both, if bounds are crossed."""
    gap = F.col("avg_interval_ms")
    reasons = F.array_compact(
        F.array(F.when(gap < min_ms, "below_minimum"), F.when(gap > max_ms, "above_maximum"))
    )
    found = edges.where(detect.deviates(min_ms, max_ms)).select(
        *EDGE_KEY, "avg_interval_ms", "packet_count", "is_periodic", F.explode(reasons).alias("reason")
    )
    return different(found, edges)


def unknown_protocol(edges: DataFrame, allowed: list[str] = catalog.ALLOWED_PROTOCOLS) -> DataFrame:
    """Unlike the detection, a missing protocol counts as unknown."""
    known = F.col("protocol").isin(allowed) if allowed else F.lit(False)
    found = edges.where(~F.coalesce(known, F.lit(False))).select(*EDGE_KEY, "packet_count", "first_seen")
    return different(found, edges)


def run_policies(
    edges: DataFrame,
    devices: DataFrame,
    device_zone: DataFrame,
    zones: DataFrame,
    baseline_end: datetime | Column,
    allowed: list[str] = catalog.ALLOWED_PROTOCOLS,
    min_ms: float = catalog.PERIODIC_MIN_MS,
    max_ms: float = catalog.PERIODIC_MAX_MS,
    mode: str = "policy",
    registry: Registry = DEFAULT,
) -> dict[str, DataFrame]:
    """All five and those registered by category; ``mode="query"`` gives the plain detections."""
    if mode == "query":
        return detect.run_detections(
            edges, devices, device_zone, zones, baseline_end, allowed, min_ms, max_ms, registry=registry
        )
    if mode != "policy":
        raise ValueError(f"unknown mode {mode!r}")
    built_in = {
        "cross_zone_violations": cross_zone(edges, device_zone, zones),
        "new_devices": new_device(devices, baseline_end),
        "new_edges": new_edge(edges, baseline_end),
        "interval_deviation": interval_deviation(edges, min_ms, max_ms),
        "unknown_protocol": unknown_protocol(edges, allowed),
    }
    return built_in | {added.name: added.violations(edges, devices) for added in registry}


class Rule(NamedTuple):
    """A user's rule: a SQL predicate over the edges or the devices."""

    name: str
    target: str
    predicate: str


def run_rules(edges: DataFrame, devices: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that fire, by rule; each table is read once for all its rules."""
    tables = {"edges": edges, "devices": devices}
    union = None
    for target, table in tables.items():
        fired = [F.when(F.expr(r.predicate), F.lit(r.name)) for r in rules if r.target == target]
        if not fired:
            continue
        rows = table.select(F.explode(F.array_compact(F.array(*fired))).alias("rule"), "*")
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    unknown = {r.target for r in rules} - set(tables)
    if unknown or union is None:
        raise ValueError(f"rules need a target of {sorted(tables)}, got {sorted(unknown)}")
    return union

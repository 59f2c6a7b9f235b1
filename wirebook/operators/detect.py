"""The five detections over the edge and device tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.operators.extensions import BUILT_IN, DEFAULT, Registry
from wirebook.schemas import EDGE_KEY

CATEGORIES = BUILT_IN
#: Tasks, about, over which a join on the protocol deals the edges of each.
PROTOCOL_SHARES = 64


def parse_allowlist(text: str) -> list[str]:
    """Comma-separated names, trimmed, empty ones dropped."""
    return [name.strip() for name in text.split(",") if name.strip()]


def cutoff(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def zone_pairs(edges: DataFrame, device_zone: DataFrame, zones: DataFrame) -> DataFrame:
    """Edges with the zones of both ends; edges of unzoned devices drop out.

    The joins are plain equi-joins on a device: Spark broadcasts the device
    zones when their size allows and otherwise sort-merges, where adaptive
    execution splits the partition of a hot device.  The zones come last, as
    the size of a join is taken for the product of both sides: device zones
    with their levels would look too large to broadcast at almost any size.
    """
    pairs = edges
    for end in ("src", "dst"):
        pairs = pairs.join(device_zone.select(F.col("ip").alias(f"{end}_ip"), F.col("zone_name").alias(f"{end}_zone")), f"{end}_ip")
    for end in ("src", "dst"):
        level = zones.select(F.col("name").alias(f"{end}_zone"), F.col("purdue_level").alias(f"{end}_level"))
        pairs = pairs.join(level, f"{end}_zone")
    return pairs.select(
        "dst_ip", "src_ip", *[c for c in edges.columns if c not in ("src_ip", "dst_ip")],
        "src_zone", "src_level", "dst_zone", "dst_level",
    )


def cross_zone_violations(
    edges: DataFrame, device_zone: DataFrame, zones: DataFrame, ordered: bool = True
) -> DataFrame:
    """Edges between Purdue levels that are more than one apart."""
    gap = F.abs(F.col("src_level") - F.col("dst_level"))
    slim = edges.select("src_ip", "dst_ip", "protocol", "port", "function_code", "packet_count")
    found = zone_pairs(slim, device_zone, zones).where(gap > 1)
    if ordered:
        found = found.orderBy(gap.desc(), *EDGE_KEY, "src_zone", "dst_zone")
    return found.select(
        "src_ip", "dst_ip", "src_zone", "dst_zone", "src_level", "dst_level", "protocol", "port", "packet_count"
    )


def new_devices(devices: DataFrame, baseline_end: datetime | Column, ordered: bool = True) -> DataFrame:
    found = devices.where(F.col("first_seen") > cutoff(baseline_end)).select(
        "ip", "mac", "role", "first_seen", "last_seen"
    )
    return found.orderBy("first_seen", "ip") if ordered else found


def new_edges(edges: DataFrame, baseline_end: datetime | Column, ordered: bool = True) -> DataFrame:
    found = edges.where(F.col("first_seen") > cutoff(baseline_end)).select(*EDGE_KEY, "first_seen", "packet_count")
    return found.orderBy("first_seen", *EDGE_KEY) if ordered else found


def deviates(min_ms: float, max_ms: float) -> Column:
    gap = F.col("avg_interval_ms")
    return (F.col("packet_count") > 1) & ((gap < min_ms) | (gap > max_ms))


def interval_deviation(
    edges: DataFrame,
    min_ms: float = catalog.PERIODIC_MIN_MS,
    max_ms: float = catalog.PERIODIC_MAX_MS,
    ordered: bool = True,
) -> DataFrame:
    """Edges seen more than once whose mean gap is outside the bounds."""
    found = edges.where(deviates(min_ms, max_ms)).select(*EDGE_KEY, "avg_interval_ms", "packet_count", "is_periodic")
    return found.orderBy("avg_interval_ms", *EDGE_KEY) if ordered else found


def unknown_protocol(
    edges: DataFrame, allowed: list[str] | DataFrame = catalog.ALLOWED_PROTOCOLS, ordered: bool = True
) -> DataFrame:
    """Edges whose protocol is not on the allowlist.

    A missing protocol is not reported, unless the allowlist is empty: then
    every edge is.  A DataFrame with a ``protocol`` column serves for lists
    too long to write down.
    """
    if isinstance(allowed, DataFrame):
        # Few protocols have most of the edges: each is dealt over many tasks, with a copy of its name for each.
        share = F.pmod(F.xxhash64("src_ip", "dst_ip", "port", "function_code"), F.lit(PROTOCOL_SHARES)).alias("share")
        shares = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PROTOCOL_SHARES - 1).cast("bigint"))).alias("share")
        listed = allowed.select("protocol").where("protocol IS NOT NULL").distinct().select("protocol", shares)
        found = edges.where("protocol IS NOT NULL").select("*", share).join(listed, ["protocol", "share"], "left_anti")
    elif allowed:
        found = edges.where(~F.col("protocol").isin(allowed))
    else:
        found = edges
    found = found.select(*EDGE_KEY, "packet_count", "first_seen")
    return found.orderBy("first_seen", *EDGE_KEY) if ordered else found


def run_detections(
    edges: DataFrame,
    devices: DataFrame,
    device_zone: DataFrame,
    zones: DataFrame,
    baseline_end: datetime | Column,
    allowed: list[str] = catalog.ALLOWED_PROTOCOLS,
    min_ms: float = catalog.PERIODIC_MIN_MS,
    max_ms: float = catalog.PERIODIC_MAX_MS,
    ordered: bool = False,
    extra: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None,
    registry: Registry = DEFAULT,
) -> dict[str, DataFrame]:
    """All five detections by category, those registered, and any added under ``extra``.

    An added detection takes (edges, devices).
    """
    found = {
        "cross_zone_violations": cross_zone_violations(edges, device_zone, zones, ordered),
        "new_devices": new_devices(devices, baseline_end, ordered),
        "new_edges": new_edges(edges, baseline_end, ordered),
        "interval_deviation": interval_deviation(edges, min_ms, max_ms, ordered),
        "unknown_protocol": unknown_protocol(edges, allowed, ordered),
    }
    for name, detection in ({d.name: d.find for d in registry} | (extra or {})).items():
        found[name] = detection(edges, devices)
    return found


def all_findings(detections: dict[str, DataFrame]) -> DataFrame:
    """One table of findings: ``category`` plus the columns of each kind."""
    union = None
    for category, found in detections.items():
        rows = found.withColumn("category", F.lit(category))
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    first = ["category", "ip", *EDGE_KEY]
    return union.select(*[c for c in first if c in union.columns], *[c for c in union.columns if c not in first])


def edge_findings(
    edges: DataFrame,
    baseline_end: datetime | Column,
    allowed: list[str] = catalog.ALLOWED_PROTOCOLS,
    min_ms: float = catalog.PERIODIC_MIN_MS,
    max_ms: float = catalog.PERIODIC_MAX_MS,
) -> DataFrame:
    """The three edge detections in one pass over the edges.

    Same rows as the union of ``new_edges``, ``interval_deviation`` and
    ``unknown_protocol``; the edges are read once instead of three times.
    """
    unknown = ~F.col("protocol").isin(allowed) if allowed else F.lit(True)
    fired = F.array_compact(
        F.array(
            F.when(F.col("first_seen") > cutoff(baseline_end), "new_edges"),
            F.when(deviates(min_ms, max_ms), "interval_deviation"),
            F.when(unknown, "unknown_protocol"),
        )
    )
    category = F.col("category")
    rows = edges.select(
        F.explode(fired).alias("category"),
        *EDGE_KEY,
        "first_seen",
        "packet_count",
        "avg_interval_ms",
        "is_periodic",
    )
    deviation = category == "interval_deviation"
    return rows.select(
        "category",
        *EDGE_KEY,
        F.when(~deviation, F.col("first_seen")).alias("first_seen"),
        "packet_count",
        F.when(deviation, F.col("avg_interval_ms")).alias("avg_interval_ms"),
        F.when(deviation, F.col("is_periodic")).alias("is_periodic"),
    )


def findings(
    edges: DataFrame,
    devices: DataFrame,
    device_zone: DataFrame,
    zones: DataFrame,
    baseline_end: datetime | Column,
    allowed: list[str] = catalog.ALLOWED_PROTOCOLS,
    min_ms: float = catalog.PERIODIC_MIN_MS,
    max_ms: float = catalog.PERIODIC_MAX_MS,
    registry: Registry = DEFAULT,
) -> DataFrame:
    """Unified findings of the five detections, which read the edges twice at most, and of those registered."""
    found = (
        cross_zone_violations(edges, device_zone, zones, ordered=False)
        .withColumn("category", F.lit("cross_zone_violations"))
        .unionByName(
            new_devices(devices, baseline_end, ordered=False).withColumn("category", F.lit("new_devices")),
            allowMissingColumns=True,
        )
        .unionByName(edge_findings(edges, baseline_end, allowed, min_ms, max_ms), allowMissingColumns=True)
    )
    for added in registry:
        rows = added.find(edges, devices).withColumn("category", F.lit(added.name))
        found = found.unionByName(rows, allowMissingColumns=True)
    return found


def finding_counts(found: DataFrame, registry: Registry = DEFAULT) -> DataFrame:
    """Findings per category, every category listed, and the total.

    Categories without a finding are counted as zero.
    """
    zero = catalog.local_frame(found.sparkSession, [(c,) for c in registry.categories], "category string")
    rows = found.select("category", F.lit(1).alias("n")).unionByName(zero.withColumn("n", F.lit(0)))
    return rows.rollup("category").agg(F.sum("n").alias("findings")).select(
        F.coalesce("category", F.lit("total")).alias("category"), "findings"
    )

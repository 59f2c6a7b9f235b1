"""Read views over the tables: inventory, one device, its edges, counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.operators import detect
from wirebook.schemas import EDGE_KEY

MAX_PAGE = 500


def devices_with_zones(devices: DataFrame, device_zone: DataFrame, zones: DataFrame) -> DataFrame:
    """Devices with a ``zone`` struct, null for those without one.

    A device in several zones has several rows.
    """
    zone = device_zone.join(zones, device_zone.zone_name == zones.name).select(
        "ip", F.struct(F.col("name"), F.col("purdue_level")).alias("zone")
    )
    return devices.join(zone, "ip", "left").select("ip", "mac", "role", "first_seen", "last_seen", "zone")


def device_inventory(devices: DataFrame, device_zone: DataFrame) -> DataFrame:
    return devices.join(device_zone.select("ip", F.col("zone_name").alias("zone")), "ip", "left").select(
        "ip", "mac", "role", "purdue_level", "first_seen", "last_seen", "zone"
    )


def list_devices(devices: DataFrame, device_zone: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """One page of the inventory in order of ip."""
    if skip < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"skip must not be negative and limit must be 1 to {MAX_PAGE}")
    return device_inventory(devices, device_zone).orderBy("ip", "zone").offset(skip).limit(limit)


def get_devices(devices: DataFrame, device_zone: DataFrame, ips: str | DataFrame) -> DataFrame:
    """Inventory rows of one ip or of a table of them; unknown ones are left out."""
    if isinstance(ips, DataFrame):
        return device_inventory(devices.join(ips.select("ip"), "ip", "left_semi"), device_zone)
    return device_inventory(devices.where(F.col("ip") == ips), device_zone.where(F.col("ip") == ips))


def device_edges(edges: DataFrame, ip: str, ordered: bool = True) -> DataFrame:
    """Outbound edges of a device, busiest first."""
    found = edges.where(F.col("src_ip") == ip).select(
        "dst_ip",
        "protocol",
        "port",
        "function_code",
        "packet_count",
        "avg_interval_ms",
        "is_periodic",
        "first_seen",
        "last_seen",
    )
    return found.orderBy(F.desc("packet_count"), *EDGE_KEY[1:]) if ordered else found


def dashboard_stats(
    edges: DataFrame,
    devices: DataFrame,
    device_zone: DataFrame,
    zones: DataFrame,
    baseline_end: datetime | Column,
    allowed: list[str] = catalog.ALLOWED_PROTOCOLS,
    min_ms: float = catalog.PERIODIC_MIN_MS,
    max_ms: float = catalog.PERIODIC_MAX_MS,
) -> DataFrame:
    """One row of counts.

    Counts over edges and over devices are conditional sums in one pass each.
    """
    unknown = ~F.col("protocol").isin(allowed) if allowed else F.lit(True)

    def many(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    by_edge = edges.agg(
        F.count("*").alias("edge_count"),
        many(F.col("first_seen") > detect.cutoff(baseline_end)).alias("new_edges"),
        many(detect.deviates(min_ms, max_ms)).alias("interval_deviation"),
        many(unknown).alias("unknown_protocol"),
    )
    by_device = devices.agg(
        F.count("*").alias("device_count"),
        many(F.col("first_seen") > detect.cutoff(baseline_end)).alias("new_devices"),
    )
    crossing = detect.cross_zone_violations(edges, device_zone, zones, ordered=False).agg(
        F.count("*").alias("cross_zone")
    )
    names = ["device_count", "edge_count", "cross_zone", "new_devices", "new_edges", "interval_deviation", "unknown_protocol"]
    rows = by_edge.unionByName(by_device, allowMissingColumns=True).unionByName(crossing, allowMissingColumns=True)
    one = rows.agg(*[F.sum(n).alias(n) for n in names])
    return one.withColumn("total_findings", sum((F.col(n) for n in names[3:]), F.col("cross_zone")))

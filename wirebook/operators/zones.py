"""Purdue zones: seeding, membership, and zones inferred from traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.functions.literals import lookup, lowest


def ensure_zones(seed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Merge the seed into the zone table.

    A zone that exists takes the level of the seed but keeps its security
    target when it has one, and its description.
    """
    if existing is None:
        return seed
    old, new = existing.alias("old"), seed.alias("new")
    in_both = F.col("old.name").isNotNull() & F.col("new.name").isNotNull()
    return old.join(new, F.col("old.name") == F.col("new.name"), "full").select(
        F.coalesce("old.name", "new.name").alias("name"),
        F.coalesce("new.purdue_level", "old.purdue_level").alias("purdue_level"),
        F.when(F.col("old.name").isNotNull(), F.col("old.description"))
        .otherwise(F.col("new.description"))
        .alias("description"),
        F.when(in_both, F.coalesce("old.sl_t", "new.sl_t"))
        .otherwise(F.coalesce("old.sl_t", "new.sl_t"))
        .alias("sl_t"),
    )


def assign_device_zones(
    assignments: DataFrame, devices: DataFrame, zones: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Add (ip, zone_name) pairs whose device and zone both exist."""
    valid = (
        assignments.select("ip", "zone_name")
        .join(devices.select("ip"), "ip", "left_semi")
        .join(zones.select(F.col("name").alias("zone_name")), "zone_name", "left_semi")
        .select("ip", "zone_name")
    )
    pairs = valid if existing is None else existing.select("ip", "zone_name").unionByName(valid)
    return pairs.dropDuplicates(["ip", "zone_name"])


def membership(device_zone: DataFrame, zones: DataFrame) -> DataFrame:
    """(ip, zone, level); a device in several zones has several rows."""
    return device_zone.join(zones, device_zone.zone_name == zones.name).select(
        "ip", F.col("name").alias("zone"), F.col("purdue_level").alias("level")
    )


def get_device_zones(device_zone: DataFrame, zones: DataFrame, ips: DataFrame | None = None) -> DataFrame:
    """Zone rows of all devices, or of those in ``ips``."""
    wanted = device_zone if ips is None else device_zone.join(ips.select("ip"), "ip", "left_semi")
    return wanted.join(zones, wanted.zone_name == zones.name).select(
        "ip", "name", "purdue_level", "description", "sl_t"
    )


def devices_without_zone(devices: DataFrame, device_zone: DataFrame) -> DataFrame:
    return devices.select("ip").join(device_zone.select("ip"), "ip", "left_anti")


def purdue_level(
    protocol: Column,
    port: Column,
    port_levels: dict[tuple[str, int], int] | None = None,
    protocol_levels: dict[str, int] | None = None,
) -> Column:
    """Level one (protocol, port) pair points to, null when none does."""
    ports = catalog.PORT_LEVELS if port_levels is None else port_levels
    names = catalog.PROTOCOL_LEVELS if protocol_levels is None else protocol_levels
    name = F.lower(protocol)
    by_port = {f"{p}:{n}": level for (p, n), level in ports.items()}
    return lowest(
        [lookup(by_port, F.concat_ws(":", name, port.cast("string")), "int"), lookup(names, name, "int")], "int"
    )


def infer_levels(observations: DataFrame, by: list[str], **rules) -> DataFrame:
    """Lowest level any (protocol, port) of a group points to, 3 if none."""
    level = purdue_level(F.col("protocol"), F.col("port"), **rules)
    return observations.groupBy(*by).agg(
        F.coalesce(F.min(level), F.lit(catalog.DEFAULT_LEVEL)).alias("purdue_level")
    )


def infer_zones(observations: DataFrame, zones: DataFrame, by: list[str], **rules) -> DataFrame:
    """Zone at the inferred level of every group."""
    levels = infer_levels(observations, by, **rules)
    return levels.join(zones.select("purdue_level", F.col("name").alias("zone_name")), "purdue_level").select(
        *by, "purdue_level", "zone_name"
    )


def auto_assign_zones(
    edges: DataFrame, zones: DataFrame, device_zone: DataFrame | None = None, **rules
) -> DataFrame:
    """Zones for devices that have none and that have spoken.

    Levels are aggregated per device before the anti-join, so a device with
    very many edges is already one row when it is joined.
    """
    spoken = edges.select(
        F.col("src_ip").alias("ip"),
        F.coalesce(F.when(F.col("protocol") != "", F.col("protocol")), F.lit("tcp")).alias("protocol"),
        F.coalesce("port", F.lit(0)).alias("port"),
    )
    inferred = infer_zones(spoken, zones, ["ip"], **rules)
    if device_zone is not None:
        inferred = inferred.join(device_zone.select("ip"), "ip", "left_anti")
    return inferred.select("ip", "zone_name")

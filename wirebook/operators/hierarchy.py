"""ISA-95 hierarchy: areas, work centers, work units and their devices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _create_absent(seed: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Rows of the seed whose name is new, after all existing rows."""
    seed = seed.dropDuplicates(["name"])
    return seed if existing is None else existing.unionByName(seed.join(existing.select("name"), "name", "left_anti"))


def ensure_areas(seed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Areas (name, description, purdue_level), level 3 unless given."""
    return _create_absent(
        seed.select("name", "description", F.coalesce("purdue_level", F.lit(3)).alias("purdue_level")), existing
    )


def ensure_nodes(seed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Work centers or work units (name, description)."""
    return _create_absent(seed.select("name", "description"), existing)


def link(seed: DataFrame, parent_column: str, parents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Links (name, parent) of the seed whose parent exists."""
    pairs = seed.select("name", F.col(parent_column).alias("parent")).join(
        parents.select(F.col("name").alias("parent")), "parent", "left_semi"
    ).select("name", "parent")
    return (pairs if existing is None else existing.unionByName(pairs)).dropDuplicates(["name", "parent"])


def link_devices(
    pairs: DataFrame, devices: DataFrame, work_units: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Links (ip, work_unit_name) whose device and work unit both exist."""
    valid = (
        pairs.select("ip", "work_unit_name")
        .join(devices.select("ip"), "ip", "left_semi")
        .join(work_units.select(F.col("name").alias("work_unit_name")), "work_unit_name", "left_semi")
        .select("ip", "work_unit_name")
    )
    return (valid if existing is None else existing.unionByName(valid)).dropDuplicates(["ip", "work_unit_name"])


def device_hierarchy(device_work_unit: DataFrame, unit_center: DataFrame, center_area: DataFrame) -> DataFrame:
    """Work unit, work center and area of every linked device."""
    centers = unit_center.select(F.col("name").alias("work_unit"), F.col("parent").alias("work_center"))
    areas = center_area.select(F.col("name").alias("work_center"), F.col("parent").alias("area"))
    return (
        device_work_unit.select("ip", F.col("work_unit_name").alias("work_unit"))
        .join(centers, "work_unit", "left")
        .join(areas, "work_center", "left")
        .select("ip", "work_unit", "work_center", "area")
    )

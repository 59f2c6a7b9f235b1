"""IEC 62443 conduits between zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.functions.literals import string_array
from wirebook.operators.detect import zone_pairs
from wirebook.schemas import EDGE_KEY


def ensure_conduits(seed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Merge the seed by name; a known conduit takes only new security levels."""
    if existing is None:
        return seed
    old, new = existing.alias("old"), seed.alias("new")
    known = F.col("old.name").isNotNull()

    def column(name: str) -> Column:
        if name in ("sl_t", "sl_a"):
            return F.coalesce(f"new.{name}", f"old.{name}").alias(name)
        return F.when(known, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}")).alias(name)

    return old.join(new, F.col("old.name") == F.col("new.name"), "full").select(*[column(c) for c in seed.columns])


def conduit_zones(conduits: DataFrame, zones: DataFrame) -> DataFrame:
    """Links (conduit, zone) of conduits both of whose zones exist."""
    names = zones.select("name")
    both = conduits.join(
        names.withColumnRenamed("name", "src_zone"), "src_zone", "left_semi"
    ).join(names.withColumnRenamed("name", "dst_zone"), "dst_zone", "left_semi")
    return both.select(
        F.col("name").alias("conduit"), F.explode(F.array_distinct(F.array("src_zone", "dst_zone"))).alias("zone_name")
    )


def with_compliance(conduits: DataFrame) -> DataFrame:
    return conduits.withColumn("is_compliant", F.col("sl_a") >= F.col("sl_t"))


def non_compliant_conduits(conduits: DataFrame, ordered: bool = True) -> DataFrame:
    found = conduits.where(F.col("sl_a") < F.col("sl_t"))
    if ordered:
        found = found.orderBy((F.col("sl_t") - F.col("sl_a")).desc(), "name")
    return found.select("name", "src_zone", "dst_zone", "sl_t", "sl_a")


def directed(conduits: DataFrame, respect_direction: bool = True) -> DataFrame:
    """Conduits in every direction they may be used in, as (z1, z2).

    Turning a conduit around up front makes the lookup an equi-join.
    """
    forward = conduits.withColumn("z1", F.col("src_zone")).withColumn("z2", F.col("dst_zone"))
    back = conduits.withColumn("z1", F.col("dst_zone")).withColumn("z2", F.col("src_zone"))
    if respect_direction:
        back = back.where("bidirectional")
    return forward.unionByName(back)


def conduits_for_zones(pairs: DataFrame, conduits: DataFrame) -> DataFrame:
    """Conduit of each (z1, z2), the first by name where there are several."""
    found = pairs.join(directed(conduits), ["z1", "z2"])
    chosen = F.min_by(F.struct("name", "sl_t", "sl_a", "allowed_protocols"), "name").alias("c")
    return found.groupBy("z1", "z2").agg(chosen).select("z1", "z2", "c.*")


def assess_protocols(pairs: DataFrame, conduits: list[catalog.Conduit] | None = None) -> DataFrame:
    """Whether each (conduit, protocol) is permitted by the conduit list.

    Case does not matter; an unknown conduit permits nothing.
    """
    allowed = F.lit(False)
    for c in catalog.CONDUITS if conduits is None else conduits:
        listed = string_array([p.lower() for p in c.allowed_protocols])
        allowed = F.when(F.col("conduit") == c.name, F.array_contains(listed, F.lower("protocol"))).otherwise(allowed)
    return pairs.withColumn("allowed", allowed)


def protocol_violations(
    edges: DataFrame, device_zone: DataFrame, zones: DataFrame, conduits: DataFrame
) -> DataFrame:
    """Edges that cross a conduit with a protocol it does not permit."""
    ways = directed(conduits).select(
        F.col("z1").alias("src_zone"),
        F.col("z2").alias("dst_zone"),
        F.col("name").alias("conduit"),
        F.transform("allowed_protocols", F.lower).alias("allowed"),
    )
    crossing = zone_pairs(edges.select(*EDGE_KEY, "packet_count"), device_zone, zones)
    return (
        crossing.join(ways, ["src_zone", "dst_zone"])
        .where(~F.array_contains("allowed", F.lower("protocol")))
        .select(*EDGE_KEY, "src_zone", "dst_zone", "conduit", "packet_count")
    )

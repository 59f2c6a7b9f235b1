"""Monitoring coverage, gaps and silent devices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.functions.literals import lookup
from wirebook.operators.conduits import directed
from wirebook.operators.detect import zone_pairs
from wirebook.operators.fold import degrees
from wirebook.operators.zones import devices_without_zone
from wirebook.sources.tables import shared_dir

# ---------------------------------------------------------------- coverage


def edge_counts(edges: DataFrame) -> DataFrame:
    """(kind, name, out_edges, in_edges) per device and per protocol, from one pass over the edges.

    Written to the shared folder, as reports read it several times; an edge
    counts once under its protocol, a missing one included.
    """
    spark, one, none = edges.sparkSession, F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def end(kind: str, name: str, out: Column, into: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"), out.alias("out_edges"), into.alias("in_edges"))

    ends = F.array(end("device", "src_ip", one, none), end("device", "dst_ip", none, one), end("protocol", "protocol", one, none))
    counted = edges.select(F.explode(ends).alias("e")).groupBy("e.kind", "e.name").agg(
        F.sum("e.out_edges").alias("out_edges"), F.sum("e.in_edges").alias("in_edges")
    )
    path = shared_dir(spark)
    counted.write.parquet(path)
    return spark.read.schema(counted.schema).parquet(path)


def _devices_of(counts: DataFrame) -> DataFrame:
    return counts.where("kind = 'device'").select(F.col("name").alias("ip"), "out_edges", "in_edges")


def zone_statistics(
    edges: DataFrame,
    device_zone: DataFrame,
    zones: DataFrame,
    ordered: bool = True,
    per_device: DataFrame | None = None,
) -> DataFrame:
    """Devices and edges of every zone, zones without devices included.

    Edges are counted per device before any join: an edge has one source and
    one target, so the sums equal the distinct counts over the joined graph.
    ``per_device`` has these counts where they are known already.
    """
    known = degrees(edges) if per_device is None else per_device
    members = device_zone.dropDuplicates(["ip", "zone_name"]).join(known, "ip", "left")
    totals = members.groupBy("zone_name").agg(
        F.count("*").alias("device_count"),
        F.sum("out_edges").alias("outbound_edges"),
        F.sum("in_edges").alias("inbound_edges"),
    )
    stats = zones.select(F.col("name").alias("zone_name"), "purdue_level").join(totals, "zone_name", "left")
    counts = ["device_count", "outbound_edges", "inbound_edges"]
    stats = stats.select(
        "zone_name", "purdue_level", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts]
    ).withColumn("blind_spot", (F.col("device_count") > 0) & (F.col("outbound_edges") == 0))
    return stats.orderBy("purdue_level", "zone_name") if ordered else stats


def observed_protocols(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("protocol") != "").select("protocol").distinct()


def missing_protocols(edges: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Expected protocols never seen, with their place in the list."""
    return _missing(observed_protocols(edges), expected)


def _missing(observed: DataFrame, expected: list[str] | None) -> DataFrame:
    names = list(expected or catalog.EXPECTED_PROTOCOLS)
    wanted = catalog.local_frame(observed.sparkSession, list(enumerate(names)), "position int, protocol string")
    seen = observed.select(F.lower("protocol").alias("seen")).distinct()
    return wanted.join(seen, F.lower(wanted.protocol) == seen.seen, "left_anti")


def asymmetric_devices(edges: DataFrame, per_device: DataFrame | None = None) -> DataFrame:
    """Devices that only send or only receive."""
    sent, received = F.col("out_edges"), F.col("in_edges")
    known = degrees(edges) if per_device is None else per_device
    return known.where((sent == 0) != (received == 0)).select(
        "ip", sent.alias("sent"), received.alias("recv")
    )


def totals(edges: DataFrame, devices: DataFrame) -> DataFrame:
    """One row: total_devices, total_edges."""
    return _pivot(
        {"total_devices": devices.select(F.lit(1)), "total_edges": edges.select(F.lit(1))}
    )


def _pivot(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables side by side."""
    union = None
    for name, table in tables.items():
        n = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        union = n if union is None else union.unionByName(n)
    return union.agg(*[F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def coverage_facts(
    edges: DataFrame,
    devices: DataFrame,
    device_zone: DataFrame,
    zones: DataFrame,
    expected: list[str] | None = None,
) -> DataFrame:
    """Coverage as rows (metric, item, value): a few per zone and protocol."""
    ends = edge_counts(edges)
    per_device, spoken = _devices_of(ends), ends.where("kind = 'protocol'")
    stats = zone_statistics(edges, device_zone, zones, ordered=False, per_device=per_device)
    per_zone = stats.select(
        "zone_name",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("device_count") == 0, F.struct(F.lit("empty_zone").alias("m"), F.lit(0).cast("bigint").alias("v"))),
                    F.when(F.col("blind_spot"), F.struct(F.lit("blind_zone").alias("m"), F.col("device_count").alias("v"))),
                    F.struct(F.lit("zone_devices").alias("m"), F.col("device_count").alias("v")),
                    F.struct(F.lit("zone_edges").alias("m"), F.col("outbound_edges").alias("v")),
                )
            )
        ).alias("f"),
    ).select(F.col("f.m").alias("metric"), F.col("zone_name").alias("item"), F.col("f.v").alias("value"))
    observed = spoken.where("name <> ''")
    protocols = observed.select(F.lit("observed_protocol").alias("metric"), F.col("name").alias("item"), F.col("out_edges").alias("value"))
    missing = _missing(observed.select(F.col("name").alias("protocol")), expected).select(
        F.lit("missing_protocol").alias("metric"),
        F.col("protocol").alias("item"),
        F.col("position").cast("bigint").alias("value"),
    )
    counts = {
        "total_devices": devices.agg(F.count("*").alias("value")),
        "total_edges": spoken.agg(F.coalesce(F.sum("out_edges"), F.lit(0)).alias("value")),
        "unzoned_devices": devices_without_zone(devices, device_zone).agg(F.count("*").alias("value")),
        "asymmetric_devices": asymmetric_devices(edges, per_device).agg(F.count("*").alias("value")),
    }
    facts = per_zone.unionByName(protocols).unionByName(missing)
    for name, count in counts.items():
        facts = facts.unionByName(count.select(F.lit(name).alias("metric"), F.lit("").alias("item"), "value"))
    return facts


def coverage_report(
    edges: DataFrame,
    devices: DataFrame,
    device_zone: DataFrame,
    zones: DataFrame,
    expected: list[str] | None = None,
) -> DataFrame:
    """One row that sums up coverage, with a score between 0 and 1.

    Zones and protocols are few and listed in the row; asymmetric devices may
    be many and are counted, ``asymmetric_devices`` lists them.
    """
    facts = coverage_facts(edges, devices, device_zone, zones, expected)
    metric, item, value = F.col("metric"), F.col("item"), F.col("value")

    def items(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(metric == name, item)))

    def number(name: str) -> Column:
        return F.coalesce(F.sum(F.when(metric == name, value)), F.lit(0)).cast("bigint")

    missing = F.sort_array(F.collect_list(F.when(metric == "missing_protocol", F.struct("value", "item"))))
    report = facts.agg(
        number("total_devices").alias("total_devices"),
        number("total_edges").alias("total_edges"),
        items("empty_zone").alias("empty_zones"),
        items("blind_zone").alias("blind_zones"),
        number("unzoned_devices").alias("unzoned_device_count"),
        items("observed_protocol").alias("observed_protocols"),
        F.transform(missing, lambda m: m["item"]).alias("missing_expected"),
        number("asymmetric_devices").alias("asymmetric_device_count"),
    )
    return report.withColumn("coverage_score", F.bround(coverage_score(), 3))


def coverage_details(edges: DataFrame, device_zone: DataFrame, zones: DataFrame) -> DataFrame:
    """The rows behind the report: (kind, name, purdue_level, devices, sent, received, blind_spot).

    Every zone, blind or not, and every device that only sends or only
    receives.  Both come from one table of degrees per device.
    """
    per_device = _devices_of(edge_counts(edges))
    stats = zone_statistics(edges, device_zone, zones, ordered=False, per_device=per_device)
    rows = stats.select(
        F.lit("zone").alias("kind"),
        F.col("zone_name").alias("name"),
        "purdue_level",
        F.col("device_count").alias("devices"),
        F.col("outbound_edges").alias("sent"),
        F.col("inbound_edges").alias("received"),
        "blind_spot",
    )
    sent, received = F.col("out_edges"), F.col("in_edges")
    one_way = per_device.where((sent == 0) != (received == 0)).select(
        F.lit("asymmetric_device").alias("kind"),
        F.col("ip").alias("name"),
        F.lit(None).cast("int").alias("purdue_level"),
        F.lit(None).cast("bigint").alias("devices"),
        sent.cast("bigint").alias("sent"),
        received.cast("bigint").alias("received"),
        F.lit(None).cast("boolean").alias("blind_spot"),
    )
    return rows.unionByName(one_way)


def coverage_score() -> Column:
    """Penalties for blind and empty zones, unzoned devices, missing protocols."""
    score = (
        F.lit(1.0)
        - F.size("blind_zones") * 0.10
        - F.size("empty_zones") * 0.05
        - F.when(F.col("unzoned_device_count") > 0, 0.15).otherwise(0.0)
        - F.size("missing_expected") * 0.05
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


# -------------------------------------------------------------------- gaps


def low_coverage_devices(
    edges: DataFrame, devices: DataFrame, min_edges: int = 2, ordered: bool = True, per_device: DataFrame | None = None
) -> DataFrame:
    """Devices with fewer than ``min_edges`` edges in and out."""
    seen = devices.select("ip").join(degrees(edges) if per_device is None else per_device, "ip", "left")
    out = F.coalesce("out_edges", F.lit(0)).cast("bigint")
    inbound = F.coalesce("in_edges", F.lit(0)).cast("bigint")
    found = seen.select(
        "ip", out.alias("out_edges"), inbound.alias("in_edges"), (out + inbound).alias("total_edges")
    ).where(F.col("total_edges") < min_edges)
    return found.orderBy("total_edges", "ip") if ordered else found


def sparse_zones(
    edges: DataFrame,
    device_zone: DataFrame,
    zones: DataFrame,
    min_density: float = 0.5,
    ordered: bool = True,
    per_device: DataFrame | None = None,
) -> DataFrame:
    """Zones with devices but few outbound edges per device."""
    stats = zone_statistics(edges, device_zone, zones, ordered=False, per_device=per_device).where("device_count > 0")
    density = F.col("outbound_edges") / F.col("device_count")
    found = stats.select(
        F.col("zone_name").alias("zone"),
        "purdue_level",
        F.col("device_count").alias("devices"),
        F.col("outbound_edges").alias("edges"),
        density.alias("edge_density"),
    ).where(F.col("edge_density") < min_density)
    return found.orderBy("edge_density", "zone") if ordered else found


def unconduit_cross_zone_edges(
    edges: DataFrame, device_zone: DataFrame, zones: DataFrame, conduits: DataFrame, ordered: bool = True
) -> DataFrame:
    """Zone pairs that talk without a conduit in either direction.

    Pairs are counted first; the anti-join then handles one row per pair.
    """
    pairs = (
        zone_pairs(edges.select("src_ip", "dst_ip"), device_zone, zones)
        .where(F.col("src_zone") != F.col("dst_zone"))
        .groupBy("src_zone", "dst_zone")
        .agg(F.count("*").alias("edge_count"))
    )
    ways = directed(conduits, respect_direction=False).select(
        F.col("z1").alias("src_zone"), F.col("z2").alias("dst_zone")
    )
    found = pairs.join(ways, ["src_zone", "dst_zone"], "left_anti")
    return found.orderBy(F.desc("edge_count"), "src_zone", "dst_zone") if ordered else found


def all_gaps(
    edges: DataFrame,
    devices: DataFrame,
    device_zone: DataFrame,
    zones: DataFrame,
    conduits: DataFrame,
    min_edges: int = 2,
    min_density: float = 0.5,
) -> DataFrame:
    """The three kinds of gap in one table, told apart by ``gap_type``; edges are read twice."""
    per_device = _devices_of(edge_counts(edges))
    kinds = {
        "low_coverage_devices": low_coverage_devices(edges, devices, min_edges, ordered=False, per_device=per_device),
        "sparse_zones": sparse_zones(edges, device_zone, zones, min_density, ordered=False, per_device=per_device),
        "unconduit_cross_zone": unconduit_cross_zone_edges(edges, device_zone, zones, conduits, ordered=False),
    }
    union = None
    for kind, rows in kinds.items():
        rows = rows.withColumn("gap_type", F.lit(kind))
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    return union


def gap_counts(gaps: DataFrame) -> DataFrame:
    """Gaps per kind and in total."""
    return gaps.rollup("gap_type").agg(F.count("*").alias("gaps")).select(
        F.coalesce("gap_type", F.lit("total")).alias("gap_type"), "gaps"
    )


# ----------------------------------------------------------------- silence


def threshold_for_role(
    role: Column,
    default_seconds: float = catalog.SILENCE_DEFAULT_SECONDS,
    role_seconds: dict[str, float] | None = None,
) -> Column:
    """Seconds a device of this role may be quiet; given roles are added."""
    seconds = {r: float(s) for r, s in {**catalog.SILENCE_SECONDS, **(role_seconds or {})}.items()}
    return F.coalesce(lookup(seconds, F.lower(role), "double"), F.lit(float(default_seconds)))


#: Severities of silence, and from how many times the threshold on.
SEVERITIES = [("low", 0.0), ("medium", 2.0), ("high", 6.0)]


def severity(silent: Column, threshold: Column) -> Column:
    ratio = silent / F.greatest(threshold, F.lit(1.0))
    (lowest, _), *higher = SEVERITIES
    found = F.lit(lowest)
    for name, times in higher:
        found = F.when(ratio >= times, name).otherwise(found)
    return found


def _silent_for(now: datetime | Column) -> Column:
    now = now if isinstance(now, Column) else F.lit(now)
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros("last_seen")) / F.lit(1e6)


def silent_devices(
    edges: DataFrame,
    devices: DataFrame,
    now: datetime | Column,
    override_seconds: float | None = None,
    default_seconds: float = catalog.SILENCE_DEFAULT_SECONDS,
    role_seconds: dict[str, float] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Devices that used to speak and have been quiet for too long.

    A device counts when it has been quiet for strictly longer than the
    shortest of all role thresholds (or the override), and at least as long as
    its own.  An override of 0 asks for the thresholds of the roles.
    """
    silent = _silent_for(now)
    shortest = min({**catalog.SILENCE_SECONDS, **(role_seconds or {})}.values())
    floor = shortest if override_seconds is None else override_seconds
    threshold = (
        F.lit(float(override_seconds))
        if override_seconds
        else threshold_for_role(F.col("role"), default_seconds, role_seconds)
    )
    speakers = edges.select(F.col("src_ip").alias("ip")).distinct()
    found = (
        devices.where(F.col("last_seen").isNotNull())
        .select("ip", "role", "last_seen", silent.alias("silent_for_s"), threshold.alias("threshold_s"))
        .where((F.col("silent_for_s") > floor) & (F.col("silent_for_s") >= F.col("threshold_s")))
        .join(speakers, "ip", "left_semi")
        .withColumn("severity", severity(F.col("silent_for_s"), F.col("threshold_s")))
    )
    return found.orderBy("last_seen", "ip") if ordered else found


def with_silence(
    devices: DataFrame,
    now: datetime | Column,
    default_seconds: float = catalog.SILENCE_DEFAULT_SECONDS,
    role_seconds: dict[str, float] | None = None,
) -> DataFrame:
    """Every device with ``is_silent``; never seen means silent."""
    threshold = threshold_for_role(F.col("role"), default_seconds, role_seconds)
    now_s = F.unix_micros((now if isinstance(now, Column) else F.lit(now)).cast("timestamp")) / F.lit(1e6)
    quiet = F.coalesce(_silent_for(now), now_s)
    return devices.withColumn("is_silent", quiet >= threshold)

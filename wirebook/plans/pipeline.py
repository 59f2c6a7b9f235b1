"""Logs to findings: the whole job, with every table written once."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from wirebook import catalog
from wirebook.operators import attack, baseline, coverage, detect, fold, procid, roles, views, zones
from wirebook.sources.events import normalize
from wirebook.sources.zeek import ZeekLogs, read_zeek


@dataclass(frozen=True)
class Graph:
    """Edge and device tables with their zones."""

    edges: DataFrame
    devices: DataFrame
    device_zone: DataFrame
    zones: DataFrame
    conduits: DataFrame


def build_graph(comm: DataFrame, root: str, inventory: DataFrame | None = None, mode: str = fold.EVENT_TIME) -> Graph:
    """Fold communications, infer zones and roles, and write the tables.

    Each step reads the written table of the step before, so the events are
    read once and a lost executor costs one step at most.
    """
    spark = comm.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    edges = written(fold.fold_edges(comm, mode), "edges")
    seen = written(fold.fold_devices(edges, inventory, mode), "devices_seen")
    zone_table = catalog.zones_frame(spark)
    device_zone = written(zones.auto_assign_zones(edges, zone_table), "device_zone")
    profiles = roles.device_profiles(edges, seen, device_zone, zone_table)
    devices = written(roles.write_roles(seen, roles.infer_roles(profiles, edges)), "devices")
    return Graph(edges, devices, device_zone, zone_table, catalog.conduits_frame(spark))


def load_graph(spark: SparkSession, root: str) -> Graph:
    """The tables of an earlier run."""
    edges, devices, device_zone = (spark.read.parquet(f"{root}/{t}") for t in ("edges", "devices", "device_zone"))
    return Graph(edges, devices, device_zone, catalog.zones_frame(spark), catalog.conduits_frame(spark))


def findings(graph: Graph, baseline_end: datetime, allowed: list[str] = catalog.ALLOWED_PROTOCOLS) -> DataFrame:
    """The five detections with ATT&CK references."""
    found = detect.findings(graph.edges, graph.devices, graph.device_zone, graph.zones, baseline_end, allowed)
    return attack.enrich(found)


def attack_map(graph: Graph, baseline_end: datetime) -> tuple[DataFrame, DataFrame]:
    """Enriched findings and their number per tactic."""
    enriched = findings(graph, baseline_end)
    return enriched, attack.summary_by_tactic(enriched)


def run(
    spark: SparkSession,
    log_directory: str,
    root: str,
    baseline_end: datetime,
    now: datetime,
    allowed: list[str] = catalog.ALLOWED_PROTOCOLS,
) -> dict[str, DataFrame]:
    """Read logs and write graph, findings and reports below ``root``."""
    parsed = read_zeek(spark, log_directory).parsed
    parsed.write.mode("overwrite").parquet(f"{root}/parsed")
    logs = ZeekLogs(spark.read.parquet(f"{root}/parsed"))
    graph = build_graph(normalize(logs.events), root)
    g = graph
    captured = baseline.capture_baselines(g.edges, now - baseline.DEFAULT_WINDOW, now, now)
    baseline.save_snapshots(captured, g.devices, f"{root}/snapshots")
    latest = baseline.read_latest(spark, f"{root}/snapshots")
    reports = {
        "findings": findings(graph, baseline_end, allowed),
        "stats": views.dashboard_stats(g.edges, g.devices, g.device_zone, g.zones, baseline_end, allowed),
        "coverage": coverage.coverage_report(g.edges, g.devices, g.device_zone, g.zones),
        "gaps": coverage.all_gaps(g.edges, g.devices, g.device_zone, g.zones, g.conduits),
        "silence": coverage.silent_devices(g.edges, g.devices, now, ordered=False),
        "process_deviations": procid.process_deviations(g.edges, ordered=False),
        "baselines": latest,
        "scores": baseline.score_all_devices(g.edges, latest),
        "baseline_ages": baseline.baseline_ages(latest, now),
        "rejected": logs.rejected,
    }
    written = {}
    for name, report in reports.items():
        report.write.mode("overwrite").parquet(f"{root}/{name}")
        written[name] = spark.read.parquet(f"{root}/{name}")
    return written

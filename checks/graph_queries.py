"""Registered queries: folds, detections, policies, joins, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base_sql import ALLOWED, NEW
from checks.registry import add
from checks.tables import BASELINE_END_US, at
from wirebook import catalog
from wirebook.operators import coverage, detect, fold, policy, views, zones
from wirebook.sources.events import of_type, union_events

CUT = at(BASELINE_END_US)
EDGE = "src_ip, dst_ip, protocol, port, function_code"
NULLS = "CAST(NULL AS VARCHAR) AS mac, CAST(NULL AS VARCHAR) AS role"

# ------------------------------------------------------------------- folds

add("PRJ-7", lambda p: p.comm.groupBy("protocol", "port", "function_code").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")),
    "SELECT protocol, port, function_code, count(*) AS n, min(ts_us) AS first_ts, max(ts_us) AS last_ts "
    "FROM comm GROUP BY ALL")
add("SET-1", lambda p: union_events(**{k: of_type(p.events, k) for k in catalog.LOG_TYPES}).groupBy("log").agg(
        F.count("*").alias("n"), F.sum("resp_p").alias("ports")),
    "SELECT log, count(*) AS n, CAST(sum(port) AS BIGINT) AS ports FROM (SELECT log, port FROM plant UNION ALL "
    "SELECT 'conn', port FROM flow) GROUP BY log")
add("AGG-1", lambda p: p.folded, f"SELECT {EDGE}, first_seen, last_seen, packet_count, avg_interval_ms, is_periodic FROM edges")
add("AGG-1-arrival", lambda p: fold.fold_edges(p.comm, fold.ARRIVAL).drop("first_seq"),
    """, a AS (
      SELECT orig_h AS src_ip, resp_h AS dst_ip, protocol, port, function_code,
             arg_min(ts_us, seq) AS first_seen, max(ts_us) AS last_seen, count(*) AS packet_count
      FROM comm GROUP BY ALL)
    SELECT *, CASE WHEN packet_count > 1 THEN (last_seen - first_seen) / 1e3 / (packet_count - 1) ELSE 0e0 END AS avg_interval_ms,
      packet_count > 1 AND (last_seen - first_seen) / 1e3 / greatest(packet_count - 1, 1) BETWEEN 100 AND 1000 AS is_periodic
    FROM a""")
add("AGG-2", lambda p: fold.fold_devices(p.folded).select("ip", "first_seen", "last_seen"), "SELECT ip, first_seen, last_seen FROM devices")
add("AGG-2-arrival",
    lambda p: fold.fold_devices(fold.fold_edges(p.comm, fold.ARRIVAL), mode=fold.ARRIVAL).select("ip", "first_seen", "last_seen"),
    """SELECT ip, arg_min(ts_us, seq) AS first_seen, max(ts_us) AS last_seen FROM (
      SELECT orig_h AS ip, ts_us, seq FROM comm UNION ALL SELECT resp_h, ts_us, seq FROM comm) GROUP BY ip""")
add("AGG-3", lambda p: coverage.totals(p.edges, p.devices),
    "SELECT (SELECT count(*) FROM devices) AS total_devices, (SELECT count(*) FROM edges) AS total_edges")


def _merged(p):
    # Two disjoint halves of the events, folded apart and merged.
    half = F.pmod(F.xxhash64("orig_h", "ts"), F.lit(2))
    return fold.merge_edges(*[fold.fold_edges(p.comm.where(half == i)) for i in (0, 1)])


add("STR-2-merge", _merged,
    f"SELECT {EDGE}, first_seen, last_seen, packet_count, avg_interval_ms, is_periodic FROM edges")

# -------------------------------------------------------------- detections

CROSS = ("SELECT src_ip, dst_ip, src_zone, dst_zone, src_level, dst_level, protocol, port, packet_count "
         "FROM pairs WHERE abs(src_level - dst_level) > 1")
DEVIATION = (f"SELECT {EDGE}, avg_interval_ms, packet_count, is_periodic FROM edges "
             "WHERE packet_count > 1 AND (avg_interval_ms < 100 OR avg_interval_ms > 1000)")
NEW_EDGES = f"SELECT {EDGE}, first_seen, packet_count FROM edges WHERE first_seen > {NEW}"
NEW_DEVICES = f"SELECT ip, mac, role, first_seen, last_seen FROM devices WHERE first_seen > {NEW}"
UNKNOWN = f"SELECT {EDGE}, packet_count, first_seen FROM edges WHERE protocol NOT IN {ALLOWED}"

add("DET-1", lambda p: detect.cross_zone_violations(p.edges, p.two_zones, p.zones), CROSS)
add("DET-2", lambda p: detect.new_devices(p.devices, CUT), NEW_DEVICES)
add("DET-3", lambda p: detect.new_edges(p.edges, CUT), NEW_EDGES)
add("DET-4", lambda p: detect.interval_deviation(p.edges), DEVIATION)
add("DET-5", lambda p: detect.unknown_protocol(p.edges), UNKNOWN)
add("DET-5-empty", lambda p: detect.unknown_protocol(p.edges, []), f"SELECT {EDGE}, packet_count, first_seen FROM edges")
add("DET-5-table", lambda p: detect.unknown_protocol(p.edges, p.edges.where("packet_count > 6").select("protocol")),
    f"SELECT {EDGE}, packet_count, first_seen FROM edges WHERE protocol NOT IN "
    "(SELECT protocol FROM edges WHERE packet_count > 6)")
FOUND = ["category", "ip", "src_ip", "dst_ip", "protocol", "port", "function_code", "packet_count", "avg_interval_ms",
         "src_zone", "dst_zone"]
add("DET-6", lambda p: detect.findings(p.edges, p.devices, p.two_zones, p.zones, CUT).select(*FOUND),
    "SELECT * FROM findings")
add("DET-6-union",
    lambda p: detect.all_findings(detect.run_detections(p.edges, p.devices, p.two_zones, p.zones, CUT)).select(*FOUND),
    "SELECT * FROM findings")
add("DET-7", lambda p: detect.finding_counts(detect.findings(p.edges, p.devices, p.two_zones, p.zones, CUT)),
    """, c AS (SELECT unnest(['cross_zone_violations','new_devices','new_edges','interval_deviation','unknown_protocol']) AS category)
    SELECT category, (SELECT count(*) FROM findings f WHERE f.category = c.category) AS findings FROM c
    UNION ALL SELECT 'total', count(*) FROM findings""")

add("POL-1", lambda p: policy.cross_zone(p.edges, p.two_zones, p.zones),
    "SELECT DISTINCT src_ip, dst_ip, src_zone, dst_zone, src_level, dst_level, protocol, port, packet_count, "
    "abs(src_level - dst_level) AS level_diff FROM pairs WHERE abs(src_level - dst_level) > 1")
add("POL-2", lambda p: policy.new_device(p.devices, CUT), NEW_DEVICES)
add("POL-3", lambda p: policy.new_edge(p.edges, CUT), NEW_EDGES)
add("POL-4", lambda p: policy.interval_deviation(p.edges, 600.0, 300.0),
    f"""SELECT {EDGE}, avg_interval_ms, packet_count, is_periodic, unnest(list_filter([
      CASE WHEN avg_interval_ms < 600 THEN 'below_minimum' END,
      CASE WHEN avg_interval_ms > 300 THEN 'above_maximum' END], lambda x: x IS NOT NULL)) AS reason
    FROM edges WHERE packet_count > 1""")


def _without_some_protocols(p):
    gone = F.when(F.col("protocol") != "dns", F.col("protocol"))
    return p.edges.withColumn("protocol", gone)


add("POL-5", lambda p: policy.unknown_protocol(_without_some_protocols(p)),
    f"""SELECT DISTINCT src_ip, dst_ip, nullif(protocol, 'dns') AS protocol, port, function_code, packet_count, first_seen
    FROM edges WHERE NOT coalesce(nullif(protocol, 'dns') IN {ALLOWED}, false)""")
add("POL-6", lambda p: detect.finding_counts(detect.all_findings(
        policy.run_policies(p.edges, p.devices, p.two_zones, p.zones, CUT))),
    """, f AS (
      SELECT category, count(*) AS findings FROM findings WHERE category <> 'cross_zone_violations' GROUP BY category
      UNION ALL SELECT 'cross_zone_violations', count(*) FROM (
        SELECT DISTINCT src_ip, dst_ip, src_zone, dst_zone, protocol, port, packet_count FROM pairs
        WHERE abs(src_level - dst_level) > 1)
      UNION ALL SELECT 'new_devices', 0 WHERE NOT EXISTS (SELECT 1 FROM findings WHERE category = 'new_devices'))
    SELECT category, findings FROM f UNION ALL SELECT 'total', CAST(sum(findings) AS BIGINT) FROM f""")
RULES = [
    policy.Rule("busy", "edges", "packet_count >= 5"),
    policy.Rule("telnet_like", "edges", "port < 1024 AND protocol NOT IN ('modbus', 'dns')"),
    policy.Rule("brief", "devices", "unix_micros(last_seen) - unix_micros(first_seen) < 2000000"),
]
add("POL-6-rules", lambda p: policy.run_rules(p.edges, p.devices, RULES).select(
        "rule", "src_ip", "dst_ip", "protocol", "port", "function_code", "ip"),
    f"""SELECT 'busy' AS rule, {EDGE}, CAST(NULL AS VARCHAR) AS ip FROM edges WHERE packet_count >= 5
    UNION ALL SELECT 'telnet_like', {EDGE}, NULL FROM edges WHERE port < 1024 AND protocol NOT IN ('modbus', 'dns')
    UNION ALL SELECT 'brief', NULL, NULL, NULL, NULL, NULL, ip FROM devices WHERE last_seen - first_seen < 2000000""")

# ------------------------------------------------------------------- joins

PAIR = "src_ip, dst_ip, protocol, port, function_code, src_zone, src_level, dst_zone, dst_level"
add("JOIN-1", lambda p: detect.zone_pairs(p.edges.select(*fold.EDGE_KEY), p.two_zones, p.zones), f"SELECT {PAIR} FROM pairs")
add("JOIN-2", lambda p: detect.zone_pairs(p.edges.select(*fold.EDGE_KEY), p.two_zones, p.zones)
        .where(F.abs(F.col("src_level") - F.col("dst_level")) > 1)
        .groupBy("src_zone", "dst_zone").agg(F.count("*").alias("n")),
    "SELECT src_zone, dst_zone, count(*) AS n FROM pairs WHERE abs(src_level - dst_level) > 1 GROUP BY ALL")
add("JOIN-3", lambda p: views.device_inventory(p.devices, p.two_zones),
    "SELECT ip, mac, role, purdue_level, first_seen, last_seen, zone_name AS zone FROM devices LEFT JOIN two USING (ip)")
add("JOIN-4", lambda p: zones.devices_without_zone(p.devices, p.two_zones),
    "SELECT ip FROM devices WHERE ip NOT IN (SELECT ip FROM two)")
add("JOIN-5", lambda p: p.devices.select("ip").join(p.edges.select(F.col("src_ip").alias("ip")), "ip", "left_semi"),
    "SELECT ip FROM devices WHERE ip IN (SELECT src_ip FROM edges)")

# ------------------------------------------------------------------- views

add("SRC-13", lambda p: views.devices_with_zones(p.devices, p.two_zones, p.zones),
    """SELECT d.ip, mac, role, first_seen, last_seen, m.zone AS zone_name, m.level AS zone_purdue_level
    FROM devices d LEFT JOIN member m USING (ip)""")
add("SRC-14", lambda p: views.list_devices(p.devices, p.two_zones, 40, 50),
    """SELECT ip, mac, role, purdue_level, first_seen, last_seen, zone_name AS zone FROM devices LEFT JOIN two USING (ip)
    ORDER BY ip, zone NULLS FIRST LIMIT 50 OFFSET 40""")
add("SRC-15", lambda p: views.get_devices(p.devices, p.two_zones, p.edges.where("is_periodic").select(F.col("dst_ip").alias("ip"))),
    """SELECT ip, mac, role, purdue_level, first_seen, last_seen, zone_name AS zone FROM devices LEFT JOIN two USING (ip)
    WHERE ip IN (SELECT dst_ip FROM edges WHERE is_periodic)""")
add("SRC-16", lambda p: views.device_edges(p.edges, "10.2.0.5"),
    """SELECT dst_ip, protocol, port, function_code, packet_count, avg_interval_ms, is_periodic, first_seen, last_seen
    FROM edges WHERE src_ip = '10.2.0.5'""")
add("SRC-17", lambda p: views.dashboard_stats(p.edges, p.devices, p.two_zones, p.zones, CUT),
    f"""SELECT (SELECT count(*) FROM devices) AS device_count, (SELECT count(*) FROM edges) AS edge_count,
      (SELECT count(*) FROM pairs WHERE abs(src_level - dst_level) > 1) AS cross_zone,
      (SELECT count(*) FROM devices WHERE first_seen > {NEW}) AS new_devices,
      (SELECT count(*) FROM edges WHERE first_seen > {NEW}) AS new_edges,
      (SELECT count(*) FROM findings WHERE category = 'interval_deviation') AS interval_deviation,
      (SELECT count(*) FROM findings WHERE category = 'unknown_protocol') AS unknown_protocol,
      (SELECT count(*) FROM findings) AS total_findings""")

# -------------------------------------------------- ordering, set operations

add("ORD-1", lambda p: detect.interval_deviation(p.edges), DEVIATION)
add("ORD-2", lambda p: views.list_devices(p.devices, p.device_zone, 0, 20).select("ip", "zone"),
    "SELECT ip, zone_name AS zone FROM devices LEFT JOIN dz USING (ip) ORDER BY ip LIMIT 20")
add("SET-4", lambda p: p.edges.select("protocol", "port").distinct(), "SELECT DISTINCT protocol, port FROM edges")

"""Registered queries: zones, conduits, hierarchy, roles, baselines, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks.base_sql import NOW
from checks.registry import add, rounded, steady
from checks.tables import BASELINE_END_US, NOW_US, T0_US, Plant, at, table
from wirebook import catalog
from wirebook.functions import stats
from wirebook.operators import (
    attack,
    baseline,
    conduits,
    coverage,
    detect,
    fold,
    hierarchy,
    policy,
    procid,
    roles,
    windows,
    zones,
)
from wirebook.operators.extensions import Registry
from wirebook.sources.tables import shared_dir

START, END, CAPTURED, NOW_AT, CUT = at(T0_US), at(T0_US + 60_000_000), at(NOW_US), at(NOW_US), at(BASELINE_END_US)
EDGE = "src_ip, dst_ip, protocol, port, function_code"

# ------------------------------------------------------------------- zones


def _old_zones(p: Plant) -> DataFrame:
    # One zone per nation, some of them named like seeded ones.
    key = F.col("n_nationkey")
    return table(p.spark, p.sf, "nation").select(
        F.when(key == 3, "Control").when(key == 4, "Field").otherwise(F.col("n_name")).alias("name"),
        F.lit(9).alias("purdue_level"),
        F.col("n_name").alias("description"),
        F.when(key % 2 == 1, (key % 4 + 1).cast("int")).alias("sl_t"),
    )


OLD_ZONES = """, old AS (
  SELECT CASE n_nationkey WHEN 3 THEN 'Control' WHEN 4 THEN 'Field' ELSE n_name END AS name, 9 AS purdue_level,
         n_name AS description, CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey % 4 + 1 END AS sl_t FROM nation)
"""
add("ONT-1", lambda p: p.zones.join(p.two_zones.groupBy(F.col("zone_name").alias("name")).agg(F.count("*").alias("devices")), "name", "left"),
    "SELECT z.*, nullif((SELECT count(*) FROM two t WHERE t.zone_name = z.name), 0) AS devices FROM zones z")
add("ONT-2", lambda p: zones.ensure_zones(p.zones, _old_zones(p)),
    OLD_ZONES + """SELECT coalesce(o.name, z.name) AS name, coalesce(z.purdue_level, o.purdue_level) AS purdue_level,
      CASE WHEN o.name IS NOT NULL THEN o.description ELSE z.description END AS description,
      CAST(coalesce(o.sl_t, z.sl_t) AS INTEGER) AS sl_t FROM old o FULL JOIN zones z ON o.name = z.name""")


def _wishes(p: Plant) -> DataFrame:
    rows = table(p.spark, p.sf, "lineitem").select("l_suppkey", "l_partkey")
    ip = F.concat(F.lit("10.2."), F.floor(F.col("l_suppkey") / 250).cast("string"), F.lit("."), (F.col("l_suppkey") % 250).cast("string"))
    names = F.array(*[F.lit(z) for z in ["Control", "Business", "Nowhere", "Field"]])
    return rows.select(
        F.when(F.col("l_partkey") % 5 == 0, F.concat(ip, F.lit("x"))).otherwise(ip).alias("ip"),
        F.element_at(names, (F.col("l_partkey") % 4 + 1).cast("int")).alias("zone_name"),
    )


add("ONT-3", lambda p: zones.assign_device_zones(_wishes(p), p.devices, p.zones, p.device_zone),
    """, w AS (SELECT '10.2.' || (l_suppkey // 250) || '.' || (l_suppkey % 250) || CASE WHEN l_partkey % 5 = 0 THEN 'x' ELSE '' END AS ip,
        ['Control','Business','Nowhere','Field'][l_partkey % 4 + 1] AS zone_name FROM lineitem)
    SELECT ip, zone_name FROM dz UNION
    SELECT ip, zone_name FROM w WHERE ip IN (SELECT ip FROM devices) AND zone_name IN (SELECT name FROM zones)""")
add("ONT-4", lambda p: zones.get_device_zones(p.two_zones, p.zones),
    "SELECT ip, name, purdue_level, description, sl_t FROM two JOIN zones ON zone_name = name")
add("ONT-5", lambda p: zones.devices_without_zone(p.devices, p.device_zone),
    "SELECT ip FROM devices WHERE ip NOT IN (SELECT ip FROM dz)")
add("ONT-6", lambda p: zones.infer_levels(p.edges.withColumnRenamed("dst_ip", "ip"), ["ip"]),
    "SELECT dst_ip AS ip, coalesce(min(level), 3) AS purdue_level FROM edge_level GROUP BY dst_ip")
add("ORD-7", lambda p: p.edges.select(*fold.EDGE_KEY, F.coalesce(
        zones.purdue_level(F.col("protocol"), F.col("port")), F.lit(catalog.DEFAULT_LEVEL)).alias("level")),
    f"SELECT {EDGE}, coalesce(level, 3) AS level FROM edge_level")
add("ONT-7", lambda p: zones.infer_zones(p.edges.withColumnRenamed("src_ip", "ip"), p.zones, ["ip"]),
    "SELECT ip, level AS purdue_level, name AS zone_name FROM device_level JOIN zones ON purdue_level = level")
add("ONT-8", lambda p: zones.auto_assign_zones(p.edges, p.zones, p.device_zone.where(F.col("ip").endswith("1"))),
    "SELECT ip, zone_name FROM dz WHERE ip NOT LIKE '%1'")

# ---------------------------------------------------------------- conduits


def _conduits(p: Plant) -> DataFrame:
    """Conduits between the zones that were seen talking, levels by traffic."""
    pairs = detect.zone_pairs(p.edges.select("src_ip", "dst_ip", "protocol"), p.two_zones, p.zones)
    return pairs.groupBy("src_zone", "dst_zone").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("protocol")).alias("allowed_protocols")
    ).select(
        F.concat_ws("-", "src_zone", "dst_zone").alias("name"), "src_zone", "dst_zone",
        (F.col("n") % 4 + 1).cast("int").alias("sl_t"), (F.floor(F.col("n") / 7) % 4 + 1).cast("int").alias("sl_a"),
        "allowed_protocols", (F.col("n") % 2 == 0).alias("bidirectional"),
    )


OWN = """, own AS (
  SELECT src_zone || '-' || dst_zone AS name, src_zone, dst_zone, CAST(count(*) % 4 + 1 AS INTEGER) AS sl_t,
         CAST((count(*) // 7) % 4 + 1 AS INTEGER) AS sl_a, list_sort(list(DISTINCT protocol)) AS allowed_protocols,
         count(*) % 2 = 0 AS bidirectional FROM pairs GROUP BY src_zone, dst_zone)
"""
add("ONT-9", lambda p: conduits.directed(p.conduits).join(_conduits(p).select(
        F.col("src_zone").alias("z1"), F.col("dst_zone").alias("z2"), F.col("sl_t").alias("seen_level")), ["z1", "z2"], "left")
        .select("name", "z1", "z2", "sl_t", "sl_a", "allowed_protocols", "bidirectional", "seen_level"),
    OWN + """, both_ways AS (SELECT *, src_zone AS z1, dst_zone AS z2 FROM conduits UNION ALL
      SELECT *, dst_zone, src_zone FROM conduits WHERE bidirectional)
    SELECT b.name, z1, z2, b.sl_t, b.sl_a, array_to_string(b.allowed_protocols, '|') AS allowed_protocols, b.bidirectional,
      o.sl_t AS seen_level FROM both_ways b LEFT JOIN own o ON o.src_zone = z1 AND o.dst_zone = z2""")
add("ONT-10", lambda p: conduits.ensure_conduits(p.conduits, _conduits(p)),
    OWN + """SELECT coalesce(o.name, c.name) AS name, CASE WHEN o.name IS NULL THEN c.src_zone ELSE o.src_zone END AS src_zone,
      CASE WHEN o.name IS NULL THEN c.dst_zone ELSE o.dst_zone END AS dst_zone, coalesce(c.sl_t, o.sl_t) AS sl_t,
      coalesce(c.sl_a, o.sl_a) AS sl_a,
      array_to_string(CASE WHEN o.name IS NULL THEN c.allowed_protocols ELSE o.allowed_protocols END, '|') AS allowed_protocols,
      CASE WHEN o.name IS NULL THEN c.bidirectional ELSE o.bidirectional END AS bidirectional
    FROM own o FULL JOIN conduits c ON o.name = c.name""")
add("ONT-10-links", lambda p: conduits.conduit_zones(_conduits(p), p.zones),
    OWN + "SELECT name AS conduit, src_zone AS zone_name FROM own UNION SELECT name, dst_zone FROM own")
add("ONT-11", lambda p: conduits.with_compliance(_conduits(p)).select("name", "sl_t", "sl_a", "is_compliant"),
    OWN + "SELECT name, sl_t, sl_a, sl_a >= sl_t AS is_compliant FROM own")
add("ONT-12", lambda p: conduits.non_compliant_conduits(_conduits(p)),
    OWN + "SELECT name, src_zone, dst_zone, sl_t, sl_a FROM own WHERE sl_a < sl_t")
add("ORD-8", lambda p: conduits.non_compliant_conduits(_conduits(p)).select("name"),
    OWN + "SELECT name FROM own WHERE sl_a < sl_t")


def _zone_pair_list(p: Plant) -> DataFrame:
    pairs = detect.zone_pairs(p.edges.select("src_ip", "dst_ip"), p.two_zones, p.zones)
    return pairs.select(F.col("dst_zone").alias("z1"), F.col("src_zone").alias("z2")).distinct()


LOOKUP = """, both_ways AS (SELECT *, src_zone AS z1, dst_zone AS z2 FROM own UNION ALL
    SELECT *, dst_zone, src_zone FROM own WHERE bidirectional)
  SELECT DISTINCT p.dst_zone AS z1, p.src_zone AS z2, b.name, b.sl_t, b.sl_a, array_to_string(b.allowed_protocols, '|') AS allowed_protocols
  FROM (SELECT DISTINCT src_zone, dst_zone FROM pairs) p JOIN both_ways b ON b.z1 = p.dst_zone AND b.z2 = p.src_zone
  QUALIFY row_number() OVER (PARTITION BY p.dst_zone, p.src_zone ORDER BY b.name) = 1"""
add("ONT-13", lambda p: conduits.conduits_for_zones(_zone_pair_list(p), _conduits(p)), OWN + LOOKUP)
add("JOIN-7", lambda p: conduits.conduits_for_zones(
        _zone_pair_list(p).where("z1 <> z2"), _conduits(p).where("src_zone <> dst_zone")).select("z1", "z2", "name"),
    OWN + """, b AS (SELECT name, src_zone AS z1, dst_zone AS z2 FROM own WHERE src_zone <> dst_zone UNION ALL
        SELECT name, dst_zone, src_zone FROM own WHERE bidirectional AND src_zone <> dst_zone)
    SELECT z1, z2, min(name) AS name FROM b
    WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.dst_zone = z1 AND p.src_zone = z2) GROUP BY z1, z2""")


def _conduit_uses(p: Plant) -> DataFrame:
    names = F.array(*[F.lit(n) for n in [*(c.name for c in catalog.CONDUITS), "Elsewhere"]])
    return p.edges.select("protocol").distinct().select(
        F.explode(names).alias("conduit"), F.upper("protocol").alias("protocol")
    )


add("ONT-14", lambda p: conduits.assess_protocols(_conduit_uses(p)),
    """SELECT n.name AS conduit, upper(e.protocol) AS protocol,
      coalesce(list_contains(c.allowed_protocols, lower(e.protocol)), false) AS allowed
    FROM (SELECT DISTINCT protocol FROM edges) e, (SELECT name FROM conduits UNION ALL SELECT 'Elsewhere') n
    LEFT JOIN conduits c ON c.name = n.name""")
add("ONT-14-edges", lambda p: conduits.protocol_violations(p.edges, p.two_zones, p.zones, p.conduits),
    f"""SELECT {EDGE}, p.src_zone, p.dst_zone, c.name AS conduit, packet_count FROM pairs p JOIN conduits c
      ON (c.src_zone = p.src_zone AND c.dst_zone = p.dst_zone)
      OR (c.bidirectional AND c.src_zone = p.dst_zone AND c.dst_zone = p.src_zone)
    WHERE NOT list_contains(c.allowed_protocols, lower(protocol))""")

# --------------------------------------------------------------- hierarchy


def _areas(p: Plant) -> DataFrame:
    key = F.col("r_regionkey")
    return table(p.spark, p.sf, "region").select(
        F.col("r_name").alias("name"), F.lit("").alias("description"), F.when(key % 2 == 0, key.cast("int")).alias("purdue_level")
    )


def _centers(p: Plant) -> DataFrame:
    regions = table(p.spark, p.sf, "region").where("r_regionkey <> 2").select("r_regionkey", "r_name")
    nations = table(p.spark, p.sf, "nation")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey, "left").select(
        F.col("n_name").alias("name"), F.lit("").alias("description"), F.col("r_name").alias("area_name")
    )


def _units(p: Plant) -> DataFrame:
    supplier, nation = table(p.spark, p.sf, "supplier"), table(p.spark, p.sf, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_name").alias("name"), F.lit("").alias("description"), F.col("n_name").alias("work_center_name"), "s_suppkey"
    )


def _unit_devices(p: Plant) -> DataFrame:
    key = F.col("s_suppkey")
    ip = F.concat(F.lit("10.2."), F.floor(key / 250).cast("string"), F.lit("."), (key % 250 + F.when(key % 9 == 0, 900).otherwise(0)).cast("string"))
    return table(p.spark, p.sf, "supplier").select(ip.alias("ip"), F.col("s_name").alias("work_unit_name"))


def _links(p: Plant) -> DataFrame:
    areas = hierarchy.ensure_areas(_areas(p))
    centers = hierarchy.ensure_nodes(_centers(p))
    units = hierarchy.ensure_nodes(_units(p))
    return hierarchy.device_hierarchy(
        hierarchy.link_devices(_unit_devices(p), p.devices, units),
        hierarchy.link(_units(p), "work_center_name", centers),
        hierarchy.link(_centers(p), "area_name", areas),
    )


DEVICE_UNIT = """, du AS (SELECT '10.2.' || (s_suppkey // 250) || '.' || (s_suppkey % 250 + CASE WHEN s_suppkey % 9 = 0 THEN 900 ELSE 0 END) AS ip,
    s_name AS work_unit, s_nationkey FROM supplier)
"""
HIERARCHY = DEVICE_UNIT + """SELECT du.ip, work_unit, n_name AS work_center, CASE WHEN r_regionkey <> 2 THEN r_name END AS area
  FROM du JOIN devices USING (ip) JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""
add("ONT-15", lambda p: hierarchy.ensure_areas(_areas(p), _areas(p).where("name < 'B'").withColumn("purdue_level", F.lit(7))),
    """SELECT r_name AS name, '' AS description, CAST(CASE WHEN r_name < 'B' THEN 7 WHEN r_regionkey % 2 = 0 THEN r_regionkey ELSE 3 END AS INTEGER) AS purdue_level
    FROM region""")
add("ONT-15-links", lambda p: hierarchy.link(_centers(p), "area_name", hierarchy.ensure_areas(_areas(p))),
    "SELECT n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2")
add("ONT-16", lambda p: hierarchy.link_devices(_unit_devices(p), p.devices, hierarchy.ensure_nodes(_units(p))),
    DEVICE_UNIT + "SELECT ip, work_unit AS work_unit_name FROM du JOIN devices USING (ip)")
add("ONT-17", _links, HIERARCHY)
add("JOIN-10", lambda p: _links(p).groupBy("area", "work_center").agg(F.count("*").alias("devices")),
    HIERARCHY.replace("SELECT du.ip", ", h AS (SELECT du.ip") + ") SELECT area, work_center, count(*) AS devices FROM h GROUP BY ALL")

# ------------------------------------------------------------------- roles

PROFILE = ["ip", "protocols", "ports", "function_codes", "connections_out", "connections_in", "total_packets_sent",
           "total_packets_recv", "avg_interval_ms", "is_periodic", "zone", "purdue_level", "role"]


def _profiles(p: Plant, mode: str) -> DataFrame:
    return roles.device_profiles(p.edges, p.devices_with_roles, p.two_zones, p.zones, mode)


def _profile_sql(out: str, inbound: str, n_out: str, n_in: str) -> str:
    return f""", o AS ({out}), i AS ({inbound}), sent AS (
      SELECT src_ip AS ip, array_to_string(list_sort(list(DISTINCT protocol)), '|') AS protocols,
        array_to_string(list_sort(list(DISTINCT port)), '|') AS ports,
        array_to_string(list_sort(list(DISTINCT function_code)), '|') AS function_codes,
        {n_out} AS connections_out, CAST(sum(packet_count) AS BIGINT) AS total_packets_sent,
        avg(CASE WHEN avg_interval_ms > 0 THEN avg_interval_ms END) AS avg_interval_ms, bool_or(is_periodic) AS is_periodic
      FROM o GROUP BY src_ip), recv AS (
      SELECT dst_ip AS ip, {n_in} AS connections_in, CAST(sum(packet_count) AS BIGINT) AS total_packets_recv FROM i GROUP BY dst_ip), z AS (
      SELECT ip, zone, level FROM member QUALIFY row_number() OVER (PARTITION BY ip ORDER BY level, zone) = 1),
    prof AS (SELECT n.ip, coalesce(protocols, '') AS protocols, coalesce(ports, '') AS ports, coalesce(function_codes, '') AS function_codes,
      coalesce(connections_out, 0) AS connections_out, coalesce(connections_in, 0) AS connections_in,
      coalesce(total_packets_sent, 0) AS total_packets_sent, coalesce(total_packets_recv, 0) AS total_packets_recv,
      avg_interval_ms, coalesce(is_periodic, false) AS is_periodic, zone, level AS purdue_level, n.role
      FROM named n LEFT JOIN sent USING (ip) LEFT JOIN recv USING (ip) LEFT JOIN z USING (ip))
    """


REF_PROFILE = _profile_sql(
    "SELECT DISTINCT src_ip, protocol, port, function_code, packet_count, avg_interval_ms, is_periodic FROM edges",
    "SELECT DISTINCT dst_ip, packet_count FROM edges", "count(*)", "count(*)")
EXACT_PROFILE = _profile_sql("SELECT * FROM edges", "SELECT * FROM edges", "count(DISTINCT dst_ip)", "count(DISTINCT src_ip)")
ROUND_PROFILE = "SELECT * REPLACE ((floor((avg_interval_ms) * 1e6 + 0.3) / 1e6) AS avg_interval_ms) FROM prof"
add("ROLE-1", lambda p: p.roles, "SELECT ip, role, confidence FROM roles")
add("ORD-5", lambda p: roles.fingerprint(p.edges.withColumnRenamed("dst_ip", "ip")),
    """, hit AS (SELECT e.dst_ip AS ip, r.* FROM edges e JOIN rule r
      ON (r.protocol IS NULL OR r.protocol = lower(e.protocol)) AND (r.port IS NULL OR r.port = e.port)
      AND (r.function_code IS NULL OR r.function_code = upper(e.function_code)))
    SELECT d.ip, coalesce(h.role, 'unknown') AS role, CAST(coalesce(h.confidence, 0) AS DOUBLE) AS confidence
    FROM (SELECT DISTINCT dst_ip AS ip FROM edges) d LEFT JOIN (
      SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY ip ORDER BY confidence DESC, idx) = 1) h USING (ip)""")
add("ROLE-1b", lambda p: roles.fingerprint(p.edges.select(
        F.col("src_ip").alias("ip"), F.when(F.col("port") != 502, F.col("protocol")).alias("protocol"),
        F.when(F.col("port") != 443, F.col("port")).alias("port"), "function_code")),
    """, o AS (SELECT src_ip AS ip, CASE WHEN port <> 502 THEN protocol ELSE 'tcp' END AS protocol,
        CASE WHEN port <> 443 THEN port ELSE 0 END AS port, function_code FROM edges), hit AS (
      SELECT o.ip, r.idx, r.role, r.confidence FROM o JOIN rule r ON (r.protocol IS NULL OR r.protocol = lower(o.protocol))
        AND (r.port IS NULL OR r.port = o.port) AND (r.function_code IS NULL OR r.function_code = upper(o.function_code)))
    SELECT d.ip, coalesce(h.role, 'unknown') AS role, CAST(coalesce(h.confidence, 0) AS DOUBLE) AS confidence
    FROM (SELECT DISTINCT ip FROM o) d LEFT JOIN (
      SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY ip ORDER BY confidence DESC, idx) = 1) h USING (ip)""")
add("JOIN-12", lambda p: p.edges.select(*fold.EDGE_KEY, roles.rule_rank(
        F.col("protocol"), F.col("port"), F.col("function_code")).alias("best")),
    f""", ranked AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, idx) - 1 AS place FROM rule)
    SELECT {", ".join("e." + c for c in EDGE.split(", "))}, CAST(min(r.place) AS INTEGER) AS best
    FROM edges e LEFT JOIN ranked r
      ON (r.protocol IS NULL OR r.protocol = lower(e.protocol)) AND (r.port IS NULL OR r.port = e.port)
     AND (r.function_code IS NULL OR r.function_code = upper(e.function_code)) GROUP BY ALL""")
add("ROLE-2", lambda p: rounded(_profiles(p, "exact"), "avg_interval_ms", places=None), EXACT_PROFILE + ROUND_PROFILE)
add("ROLE-2-reference", lambda p: rounded(_profiles(p, "reference"), "avg_interval_ms", places=None), REF_PROFILE + ROUND_PROFILE)
add("AGG-13", lambda p: _profiles(p, "reference").select("ip", "connections_out", "connections_in", "total_packets_sent", "total_packets_recv"),
    REF_PROFILE + "SELECT ip, connections_out, connections_in, total_packets_sent, total_packets_recv FROM prof")
add("ROLE-3", lambda p: rounded(roles.feature_columns(_profiles(p, "exact")).select("ip", *roles.FEATURES),
        "log_packets_sent", "log_packets_recv", "interval_ms", "fan_out_ratio", places=None),
    EXACT_PROFILE + """SELECT ip, connections_out, connections_in, (floor((ln(1 + total_packets_sent)) * 1e6 + 0.3) / 1e6) AS log_packets_sent,
      (floor((ln(1 + total_packets_recv)) * 1e6 + 0.3) / 1e6) AS log_packets_recv, (floor((coalesce(avg_interval_ms, 0)) * 1e6 + 0.3) / 1e6) AS interval_ms,
      CAST(is_periodic AS DOUBLE) AS periodic,
      CAST(list_contains(string_split(protocols, '|'), 'modbus') AS DOUBLE) AS uses_modbus,
      CAST(list_contains(string_split(protocols, '|'), 'dnp3') AS DOUBLE) AS uses_dnp3,
      CAST(list_contains(string_split(protocols, '|'), 's7comm') AS DOUBLE) AS uses_s7comm,
      CAST(contains(protocols, 'opc') AS DOUBLE) AS uses_opc,
      (floor((connections_out / greatest(connections_out + connections_in, 1)) * 1e6 + 0.3) / 1e6) AS fan_out_ratio FROM prof""")


def _trained(p: Plant) -> DataFrame:
    # Training, prediction and the comparison read the same profiles.
    profiles = p.stored("profiles", lambda: _profiles(p, "exact"))
    model = roles.fit(profiles.withColumn("label", F.col("role")))
    found = roles.predict(profiles, p.edges, model).select("ip", F.col("role").alias("predicted"), "confidence")
    names = profiles.where("role IS NOT NULL").select(F.col("role").alias("predicted"), F.lit(True).alias("known")).distinct()
    met = profiles.select("ip", "role").join(found, "ip").join(names, "predicted", "left")
    # What holds for every trained model: a label for each device, one of those learned, and the bound on confidence.
    every = Window.partitionBy(F.lit(0))  # the few rows of roles
    return met.groupBy("role").agg(
        F.count("predicted").alias("devices"), F.every(F.coalesce("known", F.lit(False))).alias("known_labels"),
        F.every(F.col("confidence").between(0, 0.99)).alias("bounded"),
        F.count(F.when(F.col("role") == F.col("predicted"), 1)).alias("right"), F.count("role").alias("labelled")
    ).withColumn("agrees", F.sum("right").over(every) >= AGREEMENT * F.sum("labelled").over(every)).drop("right", "labelled")


#: Least share of labelled devices that the model gives their role.
AGREEMENT = 0.5
add("ROLE-4", _trained,
    "SELECT role, count(*) AS devices, true AS known_labels, true AS bounded, true AS agrees FROM named GROUP BY role")
add("ROLE-5", lambda p: roles.predict(_profiles(p, "exact"), p.edges, None, "min"),
    EXACT_PROFILE + """, spoken AS (SELECT ip, unnest(string_split(protocols, '|')) AS protocol,
        list_min(list_transform(string_split(ports, '|'), lambda x: CAST(x AS INTEGER))) AS port FROM prof WHERE protocols <> ''),
      hit AS (SELECT s.ip, r.idx, r.role, r.confidence FROM spoken s JOIN rule r ON (r.protocol IS NULL OR r.protocol = lower(s.protocol))
        AND (r.port IS NULL OR r.port = s.port) AND r.function_code IS NULL)
    SELECT prof.ip, coalesce(h.role, 'unknown') AS role, CAST(coalesce(h.confidence, 0) AS DOUBLE) AS confidence
    FROM prof LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY ip ORDER BY confidence DESC, idx) = 1) h USING (ip)""")
ROLE6 = """, hit AS (SELECT e.src_ip AS ip, r.idx, r.role, r.confidence FROM edges e JOIN rule r
      ON (r.protocol IS NULL OR r.protocol = lower(e.protocol)) AND (r.port IS NULL OR r.port = e.port) AND r.function_code IS NULL),
    best AS (SELECT ip, role, confidence FROM hit QUALIFY row_number() OVER (PARTITION BY ip ORDER BY confidence DESC, idx) = 1),
    inferred AS (SELECT d.ip, coalesce(b.role, 'unknown') AS role, CAST(coalesce(b.confidence, 0) AS DOUBLE) AS confidence,
      coalesce(l.level, 3) AS purdue_level FROM devices d LEFT JOIN best b USING (ip) LEFT JOIN device_level l USING (ip)
      WHERE d.ip NOT LIKE '%3')
    """


def _some_roles(p: Plant) -> DataFrame:
    """Devices whose address ends in 3 have a role set by hand."""
    return p.devices.withColumn("role", F.when(F.col("ip").endswith("3"), "gateway"))


def _inferred(p: Plant) -> DataFrame:
    profiles = roles.device_profiles(p.edges, _some_roles(p), p.two_zones, p.zones)
    return roles.infer_roles(profiles, p.edges)


add("ROLE-6", _inferred, ROLE6 + "SELECT ip, role, confidence, purdue_level FROM inferred")
add("ROLE-6-write", lambda p: roles.write_roles(_some_roles(p), _inferred(p)).select("ip", "role", "inferred_purdue_level", "role_confidence"),
    ROLE6 + """SELECT d.ip, coalesce(i.role, CASE WHEN d.ip LIKE '%3' THEN 'gateway' END) AS role,
      i.purdue_level AS inferred_purdue_level, i.confidence AS role_confidence FROM devices d LEFT JOIN inferred i USING (ip)""")

# --------------------------------------------------------------- baselines



def _baselines(p: Plant) -> DataFrame:
    return baseline.capture_baselines(p.edges, START, END, CAPTURED)


PLACES = {"interval_mean": None, "interval_std": 6, "packet_rate_mean": 3, "packet_rate_std": 3}
ROUND_NUMBERS = ", ".join(f"round({n}, {places}) AS {n}" if places else f"floor({n} * 1e6 + 0.3) / 1e6 AS {n}" for n, places in PLACES.items())


def _numbers(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, places) if places else steady(F.col(n)) for n, places in PLACES.items()})


add("BASE-1", lambda p: _numbers(rounded(_baselines(p), "iqr_lower", "iqr_upper", places=None)),
    f"""SELECT ip, CAST({NOW} AS BIGINT) AS captured_at, CAST({T0_US} AS BIGINT) AS baseline_start, CAST({T0_US + 60_000_000} AS BIGINT) AS baseline_end,
      {ROUND_NUMBERS}, protocols, peer_count, periodic_edge_count, total_edges,
      (floor((iqr_lower) * 1e6 + 0.3) / 1e6) AS iqr_lower, (floor((iqr_upper) * 1e6 + 0.3) / 1e6) AS iqr_upper FROM fences""")
add("AGG-11", lambda p: _numbers(baseline.capture_baselines(p.edges, START, END, CAPTURED, fences=False)).select(
        "ip", *PLACES, "protocols", "peer_count", "periodic_edge_count", "total_edges"),
    f"SELECT ip, {ROUND_NUMBERS}, protocols, peer_count, periodic_edge_count, total_edges FROM profile")
add("BASE-1-samples", lambda p: rounded(baseline.samples(p.edges, START, END), "packet_rate", places=3),
    f"""SELECT src_ip AS ip, dst_ip, protocol, port, function_code, CASE WHEN is_periodic AND avg_interval_ms <> 0 THEN avg_interval_ms END AS interval_ms,
      round(CASE WHEN last_seen > first_seen THEN packet_count / ((last_seen - first_seen) / 1e6 / 60) END, 3) AS packet_rate
    FROM edges WHERE first_seen >= {T0_US} AND last_seen <= {T0_US + 60_000_000}""")
add("AGG-12", lambda p: rounded(baseline.current_intervals(p.edges), "observed_ms", places=None),
    "SELECT ip, (floor((observed_ms) * 1e6 + 0.3) / 1e6) AS observed_ms FROM observed")
add("AGG-15", lambda p: rounded(p.edges.groupBy("protocol").agg(stats.std_pop(F.col("avg_interval_ms")).alias("std")), "std"),
    "SELECT protocol, round(coalesce(stddev_pop(avg_interval_ms), 0), 6) AS std FROM edges GROUP BY protocol")
add("AGG-16", lambda p: rounded(stats.grouped_quantiles(p.edges, ["protocol"], "avg_interval_ms", {"q1": 0.25, "q3": 0.75}), "q1", "q3", places=None),
    "SELECT protocol, (floor((quantile_cont(avg_interval_ms, 0.25)) * 1e6 + 0.3) / 1e6) AS q1, (floor((quantile_cont(avg_interval_ms, 0.75)) * 1e6 + 0.3) / 1e6) AS q3 FROM edges GROUP BY protocol")
add("BASE-2", lambda p: rounded(p.edges.where("is_periodic").join(_baselines(p), F.col("src_ip") == F.col("ip")).select(
        *fold.EDGE_KEY, stats.z_score(F.col("avg_interval_ms"), F.coalesce("interval_mean", F.lit(0.0)), F.col("interval_std")).alias("z")), "z", places=4),
    f"""SELECT src_ip, dst_ip, e.protocol, port, function_code, round(CASE WHEN interval_std < 1e-9 THEN 0
      ELSE (avg_interval_ms - coalesce(interval_mean, 0)) / interval_std END, 4) AS z
    FROM (SELECT {EDGE}, avg_interval_ms FROM edges WHERE is_periodic) e JOIN profile ON ip = src_ip""".replace(f"SELECT {EDGE}, avg", f"SELECT {EDGE}, avg"))
add("BASE-3", lambda p: rounded(baseline.interval_fences(p.edges), "iqr_lower", "iqr_upper", places=None),
    """, q AS (SELECT src_ip AS ip, quantile_cont(avg_interval_ms, 0.25) AS q1, quantile_cont(avg_interval_ms, 0.75) AS q3
      FROM edges WHERE is_periodic GROUP BY src_ip HAVING count(*) >= 4)
    SELECT ip, (floor((q1 - 1.5 * (q3 - q1)) * 1e6 + 0.3) / 1e6) AS iqr_lower, (floor((q3 + 1.5 * (q3 - q1)) * 1e6 + 0.3) / 1e6) AS iqr_upper FROM q""")
SCORE = """SELECT ip, (floor((observed_ms) * 1e6 + 0.3) / 1e6) AS observed_ms, (floor((interval_mean) * 1e6 + 0.3) / 1e6) AS baseline_mean, round(z, 4) AS z_score,
  abs(z) > 3 AS z_anomalous, (floor((coalesce(iqr_lower, 0)) * 1e6 + 0.3) / 1e6) AS iqr_lower,
  coalesce((floor((iqr_upper) * 1e6 + 0.3) / 1e6), CAST('inf' AS DOUBLE)) AS iqr_upper, iqr_hit AS iqr_anomalous, abs(z) > 3 OR iqr_hit AS anomalous FROM scored"""


def _finite(df: DataFrame) -> DataFrame:
    rounded_upper = F.when(F.col("iqr_upper") < float("inf"), steady(F.col("iqr_upper"))).otherwise(F.col("iqr_upper"))
    return rounded(df, "observed_ms", "baseline_mean", "iqr_lower", places=None).withColumns(
        {"iqr_upper": rounded_upper, "z_score": F.round("z_score", 4)})


add("BASE-5", lambda p: _finite(baseline.score_all_devices(p.edges, _baselines(p))), SCORE)
add("BASE-4", lambda p: _finite(baseline.score_intervals(
        p.edges.where("packet_count > 1").select(F.col("src_ip").alias("ip"), F.col("avg_interval_ms").alias("observed_ms")), _baselines(p))),
    SCORE.replace("FROM scored", """FROM (SELECT ip, avg_interval_ms AS observed_ms, interval_mean, iqr_lower, iqr_upper,
      CASE WHEN interval_std < 1e-9 THEN 0 ELSE (avg_interval_ms - coalesce(interval_mean, 0)) / interval_std END AS z,
      coalesce(avg_interval_ms < iqr_lower OR avg_interval_ms > iqr_upper, false) AS iqr_hit
      FROM (SELECT src_ip, avg_interval_ms FROM edges WHERE packet_count > 1) e JOIN fences ON ip = src_ip)"""))
add("JOIN-13", lambda p: baseline.score_all_devices(p.edges, _baselines(p).where("periodic_edge_count > 0")).select("ip", "z_anomalous", "iqr_anomalous"),
    "SELECT s.ip, abs(z) > 3 AS z_anomalous, iqr_hit AS iqr_anomalous FROM scored s JOIN profile p ON p.ip = s.ip WHERE periodic_edge_count > 0")


#: Windows whose baselines are captured, each at its end, in seconds after the start.
CAPTURES = (1, 10, 60)


def _snapshots(p: Plant) -> DataFrame:
    """Baselines of several windows, saved for some devices only, as if the others were unknown."""
    return _taken(baseline.read_snapshots(p.spark, _saved(p, p.devices.where(F.col("ip").endswith("1") | F.col("ip").endswith("2")))))


def _saved(p: Plant, known: DataFrame) -> str:
    """Folder of a snapshot table with the baselines of several windows; the last capture is saved twice."""
    path = shared_dir(p.spark)
    for s in (*CAPTURES, CAPTURES[-1]):
        end = at(T0_US + s * 1_000_000)
        baseline.save_snapshots(baseline.capture_baselines(p.edges, START, end, end), known, path)
    return path


def _taken(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("ip", "captured_at", "total_edges", "peer_count", "periodic_edge_count", "protocols")


def _history(p: Plant) -> DataFrame:
    return _taken(baseline.read_snapshots(p.spark, _saved(p, p.devices)))


SNAP = ", snap AS (" + " UNION ALL ".join(f"""SELECT src_ip AS ip, CAST({T0_US + s * 1_000_000} AS BIGINT) AS captured_at, count(*) AS total_edges,
    count(DISTINCT dst_ip) AS peer_count, count(*) FILTER (is_periodic AND avg_interval_ms <> 0) AS periodic_edge_count,
    array_to_string(list_sort(list(DISTINCT protocol)), '|') AS protocols
  FROM edges WHERE first_seen >= {T0_US} AND last_seen <= {T0_US + s * 1_000_000} AND (src_ip LIKE '%1' OR src_ip LIKE '%2') GROUP BY src_ip""" for s in CAPTURES) + """)
  """
LATEST = "SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY ip ORDER BY captured_at DESC) = 1"
add("BASE-6", _snapshots, SNAP + "SELECT * FROM snap")
# Known devices are the feature of BASE-6; the others save every device.
SNAP_ALL = SNAP.replace(" AND (src_ip LIKE '%1' OR src_ip LIKE '%2')", "")
AGES = f"SELECT ip, ({T0_US + 90_000_000} - max(captured_at)) / 1e6 AS age_seconds FROM snap GROUP BY ip"
add("BASE-6-all", _history, SNAP_ALL + "SELECT * FROM snap")
add("BASE-7", lambda p: _taken(baseline.read_latest(p.spark, _saved(p, p.devices))), SNAP_ALL + LATEST)
add("BASE-7-all", lambda p: baseline.latest_snapshots(_history(p)), SNAP_ALL + LATEST)
add("ORD-3", lambda p: _taken(baseline.read_latest(p.spark, _saved(p, p.devices), p.devices)), SNAP_ALL + LATEST)
add("ORD-3-all", lambda p: baseline.latest_snapshots(_history(p), p.devices), SNAP_ALL + LATEST)
add("BASE-8", lambda p: baseline.baseline_ages(baseline.read_latest(p.spark, _saved(p, p.devices)), at(T0_US + 90_000_000)), SNAP_ALL + AGES)
add("BASE-8-all", lambda p: baseline.baseline_ages(_history(p), at(T0_US + 90_000_000)), SNAP_ALL + AGES)

# ----------------------------------------------------------------- windows

FEED = """, feed AS (SELECT '10.0.0.' || (user_id % 12) AS ip, us, event_type AS protocol, k % 10 + 1 AS packet_count, value FROM ev)
  """
add("WIN-1", lambda p: rounded(windows.tumbling_window(p.feed), "mean_interval_ms"),
    FEED + """SELECT ip, us // 300000000 * 300000000 AS window_start, us // 300000000 * 300000000 + 300000000 AS window_end,
      CAST(sum(packet_count) AS BIGINT) AS total_packets, round(avg(value), 6) AS mean_interval_ms, count(DISTINCT protocol) AS protocol_count
    FROM feed GROUP BY ALL""")
SLIDING = FEED + """, w AS (SELECT ip, (us // 300000000 - i) * 300000000 AS s, packet_count, value FROM feed, range(6) r(i)),
    g AS (SELECT ip, s, CAST(sum(packet_count) AS BIGINT) AS total_packets, avg(value) AS m, stddev_samp(value) AS sd FROM w GROUP BY ip, s)
  SELECT ip, s AS window_start, s + 1800000000 AS window_end, total_packets, round(m, 6) AS mean_interval_ms, round(sd, 6) AS std_interval_ms,
    coalesce(m > 0 AND sd / m > 0.2, false) AS anomaly_candidate FROM g"""
add("WIN-2", lambda p: rounded(windows.sliding_window(p.feed), "mean_interval_ms", "std_interval_ms"), SLIDING)
add("AGG-17", lambda p: windows.tumbling_window(p.feed).groupBy("ip").agg(
        F.count("*").alias("windows"), F.sum("total_packets").alias("packets"), F.max("protocol_count").alias("protocols")),
    FEED + """, t AS (SELECT ip, us // 300000000 AS w, sum(packet_count) AS n, count(DISTINCT protocol) AS c FROM feed GROUP BY ALL)
    SELECT ip, count(*) AS windows, CAST(sum(n) AS BIGINT) AS packets, max(c) AS protocols FROM t GROUP BY ip""")

# ---------------------------------------------------------------- coverage

add("AGG-4", lambda p: coverage.zone_statistics(p.edges, p.two_zones, p.zones),
    "SELECT *, device_count > 0 AND outbound_edges = 0 AS blind_spot FROM zone_stats")
add("JOIN-8", lambda p: coverage.zone_statistics(p.edges, p.device_zone, p.zones).select("zone_name", "device_count", "outbound_edges", "inbound_edges"),
    """SELECT name AS zone_name, count(DISTINCT dz.ip) AS device_count, count(DISTINCT (o.src_ip, o.dst_ip, o.protocol, o.port, o.function_code))
        FILTER (o.src_ip IS NOT NULL) AS outbound_edges,
      (SELECT count(*) FROM edges e JOIN dz d ON d.ip = e.dst_ip WHERE d.zone_name = name) AS inbound_edges
    FROM zones LEFT JOIN dz ON zone_name = name LEFT JOIN edges o ON o.src_ip = dz.ip GROUP BY name""")
add("AGG-5", lambda p: coverage.observed_protocols(p.edges), "SELECT DISTINCT protocol FROM edges WHERE protocol <> ''")
add("AGG-6", lambda p: coverage.asymmetric_devices(p.edges),
    "SELECT ip, out_edges AS sent, in_edges AS recv FROM deg WHERE (out_edges = 0) <> (in_edges = 0)")
add("AGG-7", lambda p: zones.devices_without_zone(p.devices, p.two_zones).agg(F.count("*").alias("total")),
    "SELECT count(*) AS total FROM devices WHERE ip NOT IN (SELECT ip FROM two)")
add("COV-1-details", lambda p: coverage.coverage_details(p.edges, p.two_zones, p.zones),
    """SELECT 'zone' AS kind, zone_name AS name, purdue_level, device_count AS devices, outbound_edges AS sent, inbound_edges AS received,
      device_count > 0 AND outbound_edges = 0 AS blind_spot FROM zone_stats
    UNION ALL SELECT 'asymmetric_device', ip, NULL, NULL, out_edges, in_edges, NULL FROM deg WHERE (out_edges = 0) <> (in_edges = 0)""")
LOW = "SELECT ip, out_edges, in_edges, out_edges + in_edges AS total_edges FROM deg WHERE out_edges + in_edges < 20"
add("AGG-8", lambda p: coverage.low_coverage_devices(p.edges, p.devices, 20), LOW)
add("COV-4", lambda p: coverage.low_coverage_devices(_thin(p), p.devices), LOW.replace("< 20", "< 2").replace("FROM deg", """FROM (
    SELECT ip, CAST(coalesce(sum(o), 0) AS BIGINT) AS out_edges, CAST(coalesce(sum(i), 0) AS BIGINT) AS in_edges FROM devices LEFT JOIN (
      SELECT src_ip AS ip, 1 AS o, 0 AS i FROM edges WHERE packet_count > 3 UNION ALL SELECT dst_ip, 0, 1 FROM edges WHERE packet_count > 3) USING (ip) GROUP BY ip)"""))
add("JOIN-9", lambda p: p.devices.select("ip").join(fold.degrees(p.edges), "ip", "left"), "SELECT ip, out_edges, in_edges FROM deg")
SPARSE = """SELECT zone_name AS zone, purdue_level, device_count AS devices, outbound_edges AS edges,
  outbound_edges / device_count AS edge_density FROM zone_stats WHERE device_count > 0 AND outbound_edges / device_count < 30"""
add("AGG-9", lambda p: coverage.sparse_zones(p.edges, p.two_zones, p.zones, 30.0), SPARSE)
add("COV-5", lambda p: coverage.sparse_zones(_thin(p), p.two_zones, p.zones), SPARSE.replace("< 30", "< 0.5").replace("FROM zone_stats", """FROM (
    SELECT name AS zone_name, purdue_level, count(ip) AS device_count, CAST(coalesce(sum(o), 0) AS BIGINT) AS outbound_edges
    FROM zones LEFT JOIN two ON zone_name = name LEFT JOIN (SELECT src_ip AS ip, count(*) AS o FROM edges WHERE packet_count > 3 GROUP BY src_ip) USING (ip)
    GROUP BY name, purdue_level)"""))
OPEN_PATHS = """SELECT src_zone, dst_zone, count(*) AS edge_count FROM pairs p WHERE src_zone <> dst_zone AND NOT EXISTS (
  SELECT 1 FROM conduits c WHERE (c.src_zone = p.src_zone AND c.dst_zone = p.dst_zone)
    OR (c.src_zone = p.dst_zone AND c.dst_zone = p.src_zone)) GROUP BY src_zone, dst_zone"""
add("AGG-10", lambda p: coverage.unconduit_cross_zone_edges(p.edges, p.two_zones, p.zones, p.conduits), OPEN_PATHS)
add("COV-6", lambda p: coverage.unconduit_cross_zone_edges(p.edges, p.two_zones, p.zones, p.conduits), OPEN_PATHS)
add("JOIN-6", lambda p: coverage.unconduit_cross_zone_edges(p.edges, p.device_zone, p.zones, p.conduits.where("name <> 'Supervisory-Operations'")),
    """SELECT s.zone_name AS src_zone, d.zone_name AS dst_zone, count(*) AS edge_count
    FROM edges e JOIN dz s ON s.ip = src_ip JOIN dz d ON d.ip = dst_ip WHERE s.zone_name <> d.zone_name AND NOT EXISTS (
      SELECT 1 FROM conduits c WHERE c.name <> 'Supervisory-Operations' AND ((c.src_zone = s.zone_name AND c.dst_zone = d.zone_name)
        OR (c.src_zone = d.zone_name AND c.dst_zone = s.zone_name))) GROUP BY ALL""")


def _thin(p: Plant) -> DataFrame:
    """Edges with more than three packets, as a monitor sees them that misses most flows."""
    return p.edges.where("packet_count > 3")


GAPS = f""", low AS ({LOW}), sparse AS ({SPARSE}), paths AS ({OPEN_PATHS}), gaps AS (
  SELECT 'low_coverage_devices' AS gap_type, ip, out_edges, in_edges, total_edges, NULL AS zone, NULL AS purdue_level, NULL AS devices,
    NULL AS edges, CAST(NULL AS DOUBLE) AS edge_density, NULL AS src_zone, NULL AS dst_zone, NULL AS edge_count FROM low
  UNION ALL SELECT 'sparse_zones', NULL, NULL, NULL, NULL, zone, purdue_level, devices, edges, edge_density, NULL, NULL, NULL FROM sparse
  UNION ALL SELECT 'unconduit_cross_zone', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, src_zone, dst_zone, edge_count FROM paths)
  """
add("COV-7", lambda p: coverage.all_gaps(p.edges, p.devices, p.two_zones, p.zones, p.conduits, 20, 30.0), GAPS + "SELECT * FROM gaps")
add("SET-3", lambda p: coverage.gap_counts(coverage.all_gaps(p.edges, p.devices, p.two_zones, p.zones, p.conduits, 20, 30.0)),
    GAPS + "SELECT gap_type, count(*) AS gaps FROM gaps GROUP BY gap_type UNION ALL SELECT 'total', count(*) FROM gaps")
EXPECTED = "['MODBUS','dnp3','s7comm','iec104','enip','opc-ua','bacnet']"
add("SET-2", lambda p: coverage.missing_protocols(p.edges, ["MODBUS", "dnp3", "s7comm", "iec104", "enip", "opc-ua", "bacnet"]),
    f""", x AS (SELECT unnest({EXPECTED}) AS protocol, unnest(range(7)) AS position)
    SELECT CAST(position AS INTEGER) AS position, protocol FROM x WHERE lower(protocol) NOT IN (SELECT lower(protocol) FROM edges)""")
add("COV-3", lambda p: coverage.missing_protocols(p.edges, []).select("protocol"),
    """SELECT protocol FROM (SELECT unnest(['modbus','dnp3','s7comm','iec104','enip','opc-ua','bacnet']) AS protocol)
    WHERE protocol NOT IN (SELECT lower(protocol) FROM edges)""")
REPORT = """, m AS (SELECT list(protocol ORDER BY i) AS missing FROM (
    SELECT unnest(['modbus','dnp3','s7comm','iec104','enip','opc-ua','bacnet']) AS protocol, unnest(range(7)) AS i)
    WHERE protocol NOT IN (SELECT lower(protocol) FROM edges)), r AS (SELECT
  (SELECT count(*) FROM devices) AS total_devices, (SELECT count(*) FROM edges) AS total_edges,
  coalesce((SELECT list(zone_name ORDER BY zone_name) FROM zone_stats WHERE device_count = 0), []) AS empty_zones,
  coalesce((SELECT list(zone_name ORDER BY zone_name) FROM zone_stats WHERE device_count > 0 AND outbound_edges = 0), []) AS blind_zones,
  (SELECT count(*) FROM devices WHERE ip NOT IN (SELECT ip FROM two)) AS unzoned_device_count,
  (SELECT list(DISTINCT protocol ORDER BY protocol) FROM edges WHERE protocol <> '') AS observed_protocols,
  coalesce((SELECT missing FROM m), []) AS missing_expected,
  (SELECT count(*) FROM deg WHERE (out_edges = 0) <> (in_edges = 0)) AS asymmetric_device_count), s AS (
  SELECT *, greatest(0, least(1, 1.0 - 0.1 * len(blind_zones) - 0.05 * len(empty_zones)
    - CASE WHEN unzoned_device_count > 0 THEN 0.15 ELSE 0 END - 0.05 * len(missing_expected))) AS score FROM r)
  """
add("COV-1", lambda p: coverage.coverage_report(p.edges, p.devices, p.two_zones, p.zones),
    REPORT + """SELECT total_devices, total_edges, array_to_string(empty_zones, '|') AS empty_zones, array_to_string(blind_zones, '|') AS blind_zones,
      unzoned_device_count, array_to_string(observed_protocols, '|') AS observed_protocols, array_to_string(missing_expected, '|') AS missing_expected,
      asymmetric_device_count, CAST(round(score, 3) AS DOUBLE) AS coverage_score FROM s""")
add("COV-2", lambda p: coverage.coverage_report(p.edges, p.devices, p.device_zone, p.zones, ["profinet"]).select("coverage_score"),
    """SELECT CAST(round(1 - 0.05 * (SELECT count(*) FROM zones WHERE name NOT IN (SELECT zone_name FROM dz))
      - CASE WHEN EXISTS (SELECT 1 FROM devices WHERE ip NOT IN (SELECT ip FROM dz)) THEN 0.15 ELSE 0 END - 0.05, 3) AS DOUBLE) AS coverage_score""")

# ----------------------------------------------------------------- silence

SEVERITY = "CASE WHEN silent_for_s / greatest(threshold_s, 1) >= 6 THEN 'high' WHEN silent_for_s / greatest(threshold_s, 1) >= 2 THEN 'medium' ELSE 'low' END AS severity"
add("SIL-1", lambda p: p.devices_with_roles.select("ip", "role", coverage.threshold_for_role(F.upper("role")).alias("threshold_s")),
    "SELECT ip, role, threshold_s FROM quiet")
add("SIL-2", lambda p: coverage.silent_devices(p.edges, p.devices_with_roles, NOW_AT),
    f"SELECT ip, role, last_seen, silent_for_s, threshold_s, {SEVERITY} FROM quiet WHERE silent_for_s > 300 AND silent_for_s >= threshold_s "
    "AND ip IN (SELECT src_ip FROM edges)")
add("SIL-3", lambda p: coverage.silent_devices(p.edges, p.devices_with_roles, NOW_AT, override_seconds=95.0).groupBy("severity").agg(F.count("*").alias("n")),
    f"""SELECT severity, count(*) AS n FROM (SELECT {SEVERITY.replace("threshold_s", "95")} FROM quiet WHERE silent_for_s > 95
    AND ip IN (SELECT src_ip FROM edges)) GROUP BY severity""")
add("SIL-2-zero", lambda p: coverage.silent_devices(p.edges, p.devices_with_roles, at(NOW_US - 10_000_000), override_seconds=0).select("ip", "threshold_s"),
    f"""SELECT ip, threshold_s FROM quiet WHERE silent_for_s - 10 > 0 AND ({NOW} - 10000000 - last_seen) / 1e6 >= threshold_s
    AND ip IN (SELECT src_ip FROM edges)""")
add("SIL-4", lambda p: coverage.with_silence(p.devices_with_roles, NOW_AT).select("ip", "is_silent"),
    "SELECT ip, silent_for_s >= threshold_s AS is_silent FROM quiet")

# ------------------------------------------------------------------ ATT&CK


def _found(p: Plant) -> DataFrame:
    return detect.findings(p.edges, p.devices, p.two_zones, p.zones, CUT)


ENRICH = """, f AS (SELECT *, row_number() OVER () AS id FROM findings), sig AS (
    SELECT id, signal, 0 AS place FROM f JOIN cat_signal USING (category)
    UNION ALL SELECT id, unnest(['write_register','unusual_function_code']), unnest([1, 2]) FROM f WHERE upper(function_code) IN (SELECT code FROM write_code)
    UNION ALL SELECT id, 'interval_deviation', 3 FROM f WHERE avg_interval_ms IS NOT NULL),
  hit AS (SELECT id, t.idx, t.technique_id, t.tactic_id, min(place * 100 + t.idx) AS o FROM sig JOIN tech_signal t USING (signal) GROUP BY ALL),
  tac AS (SELECT id, tactic_id, min(o) AS o FROM hit GROUP BY ALL),
  ids AS (SELECT id, string_agg(technique_id, '|' ORDER BY o) AS technique_ids FROM hit GROUP BY id),
  tids AS (SELECT id, string_agg(tactic_id, '|' ORDER BY o) AS tactic_ids FROM tac GROUP BY id)
  """
add("ATK-4", lambda p: attack.enrich(_found(p)).select("category", "ip", "src_ip", "dst_ip", "protocol", "function_code", "technique_ids", "tactic_ids"),
    """, f AS (SELECT *, coalesce(upper(function_code) IN (SELECT code FROM write_code), false) AS writes, avg_interval_ms IS NOT NULL AS timed FROM findings),
  kind AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT category, writes, timed FROM f)),
  sig AS (SELECT id, signal, 0 AS place FROM kind JOIN cat_signal USING (category)
    UNION ALL SELECT id, unnest(['write_register','unusual_function_code']), unnest([1, 2]) FROM kind WHERE writes
    UNION ALL SELECT id, 'interval_deviation', 3 FROM kind WHERE timed),
  hit AS (SELECT id, t.idx, t.technique_id, t.tactic_id, min(place * 100 + t.idx) AS o FROM sig JOIN tech_signal t USING (signal) GROUP BY ALL),
  tac AS (SELECT id, tactic_id, min(o) AS o FROM hit GROUP BY ALL),
  refs AS (SELECT category, writes, timed, (SELECT string_agg(technique_id, '|' ORDER BY o) FROM hit WHERE hit.id = kind.id) AS technique_ids,
    (SELECT string_agg(tactic_id, '|' ORDER BY o) FROM tac WHERE tac.id = kind.id) AS tactic_ids FROM kind)
  SELECT category, ip, src_ip, dst_ip, protocol, function_code, technique_ids, tactic_ids FROM f JOIN refs USING (category, writes, timed)""")
add("ATK-5", lambda p: attack.enrich(_found(p)).select("category", F.explode("techniques").alias("t"))
        .groupBy("category", "t.technique_id", "t.name", "t.tactic_id", "t.tactic_name").agg(F.count("*").alias("n")),
    ENRICH + """SELECT category, h.technique_id, t.name, h.tactic_id, c.name AS tactic_name, count(*) AS n FROM hit h JOIN f USING (id)
      JOIN techniques t ON t.technique_id = h.technique_id JOIN tactics c ON c.tactic_id = h.tactic_id GROUP BY ALL""")
add("ATK-6", lambda p: attack.summary_by_tactic(attack.enrich(_found(p))),
    ENRICH + "SELECT c.name AS tactic, count(*) AS findings FROM tac JOIN tactics c USING (tactic_id) GROUP BY c.name")
add("AGG-14", lambda p: attack.summary_by_tactic(attack.enrich(p.edges.select(F.lit("process_deviation").alias("category"), "function_code"))),
    """, f AS (SELECT row_number() OVER () AS id, function_code FROM edges), sig AS (SELECT id, 'process_deviation' AS signal FROM f UNION ALL
      SELECT id, unnest(['write_register','unusual_function_code']) FROM f WHERE upper(function_code) IN (SELECT code FROM write_code)),
      t AS (SELECT DISTINCT id, tactic_id FROM sig JOIN tech_signal USING (signal))
    SELECT name AS tactic, count(*) AS findings FROM t JOIN tactics USING (tactic_id) GROUP BY name""")
add("ATK-3", lambda p: p.edges.select(*fold.EDGE_KEY, attack.signals(
        F.lit("new_edges"), F.lower("function_code"), F.when(F.col("is_periodic"), F.col("avg_interval_ms"))).alias("signals")),
    f"""SELECT {EDGE}, 'new_edge' || CASE WHEN upper(function_code) IN (SELECT code FROM write_code) THEN '|write_register|unusual_function_code' ELSE '' END
      || CASE WHEN is_periodic THEN '|interval_deviation' ELSE '' END AS signals FROM edges""")


def _category_counts(p: Plant) -> DataFrame:
    signal = F.element_at(F.create_map(*[F.lit(x) for kv in catalog.CATEGORY_SIGNALS.items() for x in kv]), F.col("category"))
    return _found(p).groupBy(signal.alias("signal")).agg(F.count("*").alias("findings"))


add("ATK-1", lambda p: catalog.techniques_frame(p.spark).select("technique_id", "tactic_id", F.explode("detection_signals").alias("signal"))
        .join(_category_counts(p), "signal", "left").join(catalog.tactics_frame(p.spark).select("tactic_id", F.col("name").alias("tactic")), "tactic_id")
        .select("technique_id", "tactic", "signal", F.coalesce("findings", F.lit(0)).alias("findings")),
    """SELECT technique_id, name AS tactic, signal, coalesce(n, 0) AS findings FROM tech_signal JOIN tactics USING (tactic_id)
    LEFT JOIN (SELECT signal, count(*) AS n FROM findings JOIN cat_signal USING (category) GROUP BY signal) USING (signal)""")
INDEX = """, idx AS (SELECT signal, string_agg(technique_id, '|' ORDER BY idx) AS technique_ids FROM tech_signal GROUP BY signal)
  SELECT signal, technique_ids, coalesce(n, 0) AS findings FROM idx
  LEFT JOIN (SELECT signal, count(*) AS n FROM findings JOIN cat_signal USING (category) GROUP BY signal) USING (signal)"""
add("ATK-2", lambda p: attack.signal_index(catalog.techniques_frame(p.spark)).join(_category_counts(p), "signal", "left")
        .withColumn("findings", F.coalesce("findings", F.lit(0))), INDEX)
add("JOIN-11", lambda p: attack.signal_index(catalog.techniques_frame(p.spark)).join(
        p.edges.groupBy(F.when(F.col("packet_count") > 1, "interval_deviation").otherwise("new_edge").alias("signal")).agg(F.count("*").alias("n")), "signal"),
    """, idx AS (SELECT signal, string_agg(technique_id, '|' ORDER BY idx) AS technique_ids FROM tech_signal GROUP BY signal)
    SELECT signal, technique_ids, count(*) AS n FROM (SELECT CASE WHEN packet_count > 1 THEN 'interval_deviation' ELSE 'new_edge' END AS signal FROM edges)
    JOIN idx USING (signal) GROUP BY ALL""")


# ---------------------------------------------------- detections of the user's


def _low_ports(edges: DataFrame, devices: DataFrame) -> DataFrame:
    return edges.where("port < 1024 AND packet_count >= 3").select(*fold.EDGE_KEY, "packet_count", "first_seen")


ADDED = Registry()
ADDED.register("low_ports", _low_ports, signal="low_port")
ADDED.register("brief_devices", lambda edges, devices: devices.where(F.col("last_seen") == F.col("first_seen")).select("ip", "first_seen", "last_seen"))
OWN = attack.Catalogue(
    [catalog.Technique("T9001", "Own", "TA0102", "", ["low_port", "new_device"]), catalog.Technique("T9002", "Other", "TA9", "", ["low_port", "write_register"])],
    [catalog.Tactic("TA0102", "Discovery", "")])


def _with_added(p: Plant) -> DataFrame:
    return detect.findings(p.edges, p.devices, p.two_zones, p.zones, CUT, registry=ADDED)


WITH_ADDED = """, more AS (SELECT category, ip, src_ip, dst_ip, protocol, port, function_code FROM findings
    UNION ALL SELECT 'low_ports', NULL, src_ip, dst_ip, protocol, port, function_code FROM edges WHERE port < 1024 AND packet_count >= 3
    UNION ALL SELECT 'brief_devices', ip, NULL, NULL, NULL, NULL, NULL FROM devices WHERE last_seen = first_seen),
  hits AS (SELECT *, category IN ('low_ports', 'new_devices') AS own, category = 'low_ports' OR coalesce(upper(function_code) IN (SELECT code FROM write_code), false) AS other FROM more)
  """
add("UDF-1", lambda p: attack.enrich(_with_added(p), OWN, ADDED).select("category", "ip", "src_ip", "dst_ip", "protocol", "port", "function_code", "technique_ids", "tactic_ids"),
    WITH_ADDED + """SELECT category, ip, src_ip, dst_ip, protocol, port, function_code,
    concat_ws('|', CASE WHEN own THEN 'T9001' END, CASE WHEN other THEN 'T9002' END) AS technique_ids,
    concat_ws('|', CASE WHEN own THEN 'TA0102' END, CASE WHEN other THEN 'TA9' END) AS tactic_ids FROM hits""")
add("UDF-1-counts", lambda p: detect.finding_counts(_with_added(p), ADDED),
    WITH_ADDED + """, c AS (SELECT unnest(['cross_zone_violations','new_devices','new_edges','interval_deviation','unknown_protocol','low_ports','brief_devices']) AS category)
    SELECT category, (SELECT count(*) FROM more m WHERE m.category = c.category) AS findings FROM c UNION ALL SELECT 'total', count(*) FROM more""")
add("UDF-1-policies", lambda p: policy.run_policies(p.edges, p.devices, p.two_zones, p.zones, CUT, registry=ADDED)["low_ports"].select(*fold.EDGE_KEY),
    f"SELECT {EDGE} FROM edges WHERE port < 1024 AND packet_count >= 3")
add("UDF-1-tactics", lambda p: attack.summary_by_tactic(attack.enrich(_with_added(p), OWN, ADDED), OWN),
    WITH_ADDED + "SELECT 'Discovery' AS tactic, count(*) AS findings FROM hits WHERE own UNION ALL SELECT 'TA9', count(*) FROM hits WHERE other")


def _known_tactics(p: Plant) -> DataFrame:
    """A tactic table as an older load left it, some names out of date."""
    seen = attack.enrich(_found(p)).select(F.explode("tactic_ids").alias("tactic_id")).groupBy("tactic_id").agg(F.count("*").alias("n"))
    return seen.select("tactic_id", F.lit("old name").alias("name"), F.concat(F.lit("seen "), F.col("n").cast("string")).alias("description"))


add("ATK-7", lambda p: attack.ensure_named(catalog.tactics_frame(p.spark), _known_tactics(p), "tactic_id"),
    ENRICH + """SELECT c.tactic_id, c.name, coalesce('seen ' || n, c.description) AS description FROM tactics c
    LEFT JOIN (SELECT tactic_id, count(*) AS n FROM tac GROUP BY tactic_id) USING (tactic_id)""")
add("ATK-7-links", lambda p: attack.technique_tactics(catalog.techniques_frame(p.spark), _known_tactics(p)),
    ENRICH + "SELECT technique_id, tactic_id FROM techniques WHERE tactic_id IN (SELECT tactic_id FROM tac)")

# ------------------------------------------------------- process signatures

LONG = [
    catalog.Signature("PollThenWrite", [catalog.Step("modbus", ["READ_COILS"]), catalog.Step("MODBUS", ["read_holding_registers"]),
                                        catalog.Step("modbus", ["WRITE_SINGLE_COIL"])]),
    catalog.Signature("MixedCycle", [catalog.Step("dnp3", ["READ"]), catalog.Step("modbus", []), catalog.Step("dnp3", ["SELECT"]),
                                     catalog.Step("smb", []), catalog.Step("modbus", ["DIAGNOSTICS"])]),
    catalog.Signature("FlowPair", [catalog.Step("dns", []), catalog.Step("https", ["FLOW"]), catalog.Step("s7comm", [])]),
    catalog.Signature("NeverEnds", [catalog.Step("bacnet", []), catalog.Step("udp", []), catalog.Step("iec104", [])]),
]


def _greedy_sql(signatures) -> str:
    """Greedy matching by a chain of minima over row numbers, per signature."""
    parts = [""", obs AS (SELECT src_ip AS ip, lower(protocol) AS protocol, upper(function_code) AS fc,
      row_number() OVER (PARTITION BY src_ip ORDER BY first_seen, protocol, function_code, dst_ip, port) AS n FROM edges)"""]
    selects = []
    for i, s in enumerate(signatures):
        previous = None
        for j, step in enumerate(s.steps):
            codes = "(" + ", ".join(f"'{c.upper()}'" for c in step.function_codes) + ")"
            fits = f"o.protocol = '{step.protocol.lower()}'" + (f" AND o.fc IN {codes}" if step.function_codes else "")
            if previous is None:
                parts.append(f"s{i}_{j} AS (SELECT ip, min(n) AS n FROM obs o WHERE {fits} GROUP BY ip)")
            else:
                parts.append(f"s{i}_{j} AS (SELECT o.ip, min(o.n) AS n FROM obs o JOIN {previous} p ON p.ip = o.ip AND o.n > p.n WHERE {fits} GROUP BY o.ip)")
            previous = f"s{i}_{j}"
            selects.append(f"SELECT ip, {i} AS i, '{s.name}' AS signature_name, {len(s.steps)} AS n_steps FROM {previous}")
    parts.append("steps AS (SELECT ip, i, signature_name, n_steps, count(*) AS matched FROM ("
                 + " UNION ALL ".join(selects) + ") GROUP BY ip, i, signature_name, n_steps)")
    parts.append("m AS (SELECT *, matched / n_steps AS score FROM steps)")
    return ", ".join(parts) + " "


MATCH = "SELECT ip, signature_name, CAST(matched AS INTEGER) AS matched, n_steps, matched = n_steps AS full_match, round(score, 6) AS score FROM m"


def _matches(p: Plant, signatures, **kw) -> DataFrame:
    found = procid.match_signatures(p.edges, signatures, **kw)
    return rounded(found.select("ip", "signature_name", "matched", "n_steps", "full_match", "score"), "score")


add("PID-1", lambda p: p.edges.where(procid.step_matches(catalog.SIGNATURES[0].steps[1], F.upper("protocol"), F.lower("function_code"))).select(*fold.EDGE_KEY),
    f"SELECT {EDGE} FROM edges WHERE lower(protocol) = 'modbus' AND upper(function_code) IN ('READ_HOLDING_REGISTERS', 'READ_INPUT_REGISTERS')")
add("PID-2", lambda p: _matches(p, LONG, min_score=0.01), _greedy_sql(LONG) + MATCH)
add("PID-3", lambda p: _matches(p, None), _greedy_sql(catalog.SIGNATURES) + MATCH + " WHERE matched = n_steps OR score >= 0.6")
add("PID-3-full", lambda p: _matches(p, LONG, partial=False), _greedy_sql(LONG) + MATCH + " WHERE matched = n_steps")
SCORED = """, d AS (SELECT *, 1 - score AS deviation, matched = n_steps AS full_match FROM m WHERE score >= 0.3)
  SELECT ip, signature_name, n_steps AS expected_steps, CAST(matched AS INTEGER) AS matched_steps, round(score, 6) AS score,
    round(deviation, 6) AS deviation, deviation > 0.3 AS flagged, CASE WHEN full_match THEN 'Full match: all ' || n_steps || ' steps matched.'
      WHEN deviation > 0.3 THEN 'Partial match: ' || matched || '/' || n_steps || ' steps matched (deviation=' || CAST(round_even(deviation * 100, 0) AS INTEGER) || '%).'
      ELSE 'Acceptable match: ' || matched || '/' || n_steps || ' steps (deviation=' || CAST(round_even(deviation * 100, 0) AS INTEGER) || '%).' END AS detail
  FROM d"""
add("PID-4", lambda p: rounded(procid.score_matches(procid.match_signatures(p.edges, LONG, min_score=0.3), known=LONG).drop("signature_idx"), "score", "deviation"),
    _greedy_sql(LONG) + SCORED)
add("PID-5", lambda p: rounded(procid.process_deviations(p.edges, LONG, min_score=0.3, known=LONG), "score", "deviation"),
    _greedy_sql(LONG) + SCORED + " WHERE deviation > 0.3")
add("ORD-6", lambda p: procid.process_deviations(p.edges, LONG, min_score=0.3, known=LONG).select("ip", "signature_name"),
    _greedy_sql(LONG) + "SELECT ip, signature_name FROM m WHERE score >= 0.3 AND 1 - score > 0.3")
add("PID-6", lambda p: catalog.signatures_frame(p.spark).select("name", F.posexplode("steps").alias("step", "s")).join(
        p.edges.groupBy(F.lower("protocol").alias("protocol"), "function_code").agg(F.count("*").alias("edges")),
        (F.col("s.protocol") == F.col("protocol")) & F.array_contains("s.function_codes", F.col("function_code")), "left")
        .select("name", "step", F.col("s.protocol").alias("protocol"), "function_code", F.coalesce("edges", F.lit(0)).alias("edges")),
    ", steps AS (" + " UNION ALL ".join(
        f"SELECT '{s.name}' AS name, {j} AS step, '{st.protocol}' AS protocol, unnest({list(st.function_codes)}) AS function_code"
        for s in catalog.SIGNATURES for j, st in enumerate(s.steps)) +
    "), met AS (SELECT name, step, s.protocol, s.function_code, count(*) AS edges FROM steps s JOIN edges e ON s.protocol = lower(e.protocol) "
    "AND s.function_code = e.function_code GROUP BY ALL) SELECT * FROM met UNION ALL "
    "SELECT DISTINCT name, step, protocol, NULL, 0 FROM steps WHERE (name, step) NOT IN (SELECT (name, step) FROM met)")
add("ORD-4", lambda p: procid.device_sequences(p.edges),
    "SELECT src_ip AS ip, first_seen, protocol, function_code, dst_ip, port FROM edges")

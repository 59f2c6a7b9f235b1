"""DuckDB form of the derived tables: common table expressions for all checks."""

from __future__ import annotations

from checks.tables import BASELINE_END_US, NOW_US, SHIP0_US, T0_US
from wirebook import catalog


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(c) if isinstance(c, (int, float)) else _text(c) for c in r) + ")" for r in rows)


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


NEW = f"{BASELINE_END_US}"
NOW = f"{NOW_US}"
ALLOWED = "(" + ", ".join(_text(p) for p in catalog.ALLOWED_PROTOCOLS) + ")"

BASE = f"""
WITH ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events
), plant AS (
  SELECT event_id, k, us,
    CASE event_type WHEN 'click' THEN 'modbus' WHEN 'view' THEN 'dnp3' ELSE 'conn' END AS log,
    {T0_US} + (us - {T0_US}) // (CASE user_id % 3 WHEN 0 THEN 30000 WHEN 1 THEN 300000 ELSE 3000000 END) AS ts_us,
    'C' || event_id AS uid,
    CASE WHEN k % 5 = 0 THEN '10.1.0.' || (k % 4) ELSE '10.0.0.' || (user_id % 12) END AS orig_h,
    40000 + k AS orig_p,
    CASE WHEN k % 5 = 0 THEN '10.0.0.' || (user_id % 12) ELSE '10.1.0.' || (k % 4) END AS resp_h,
    CASE event_type WHEN 'click' THEN 502 WHEN 'view' THEN 20000 WHEN 'purchase' THEN 4840
                    WHEN 'signup' THEN 443 ELSE 445 END AS port,
    CASE WHEN event_type = 'click' THEN
      ['READ_COILS','READ_HOLDING_REGISTERS','WRITE_SINGLE_COIL','DIAGNOSTICS'][(k // 4) % 4 + 1] END AS func,
    CASE WHEN event_type = 'click' AND k % 7 = 0 THEN 'ILLEGAL_FUNCTION' END AS exception,
    CASE WHEN event_type = 'view' THEN ['READ','RESPONSE','SELECT'][(k // 4) % 3 + 1] END AS fc_request,
    CASE WHEN event_type = 'view' AND k % 3 = 0 THEN 'RESPONSE' END AS fc_reply,
    CASE WHEN event_type = 'view' AND k % 2 = 0 THEN CAST(k * 10 AS BIGINT) END AS iin,
    CASE event_type WHEN 'purchase' THEN 'opc-ua' WHEN 'signup' THEN 'https' WHEN 'error' THEN 'smb' END AS service,
    CASE WHEN event_type NOT IN ('click','view') THEN 'tcp' END AS proto,
    CASE WHEN event_type NOT IN ('click','view') THEN value END AS duration,
    CASE WHEN event_type NOT IN ('click','view') THEN CAST(k * 100 AS BIGINT) END AS orig_bytes,
    CASE WHEN event_type NOT IN ('click','view') THEN k % 2 = 0 END AS local_orig,
    CASE WHEN event_type NOT IN ('click','view') AND k % 4 = 0 THEN 'p' || k END AS tunnel_parents,
    event_id AS seq
  FROM ev
), flow AS (
  SELECT
    {T0_US} + (epoch_us(l_shipdate) - {SHIP0_US}) // (CASE l_suppkey % 2 WHEN 0 THEN 140000000 ELSE 14000000 END) AS ts_us,
    CASE WHEN l_partkey % 11 = 0 THEN '10.3.' || (l_partkey // 250) || '.' || (l_partkey % 250)
         ELSE '10.2.' || (l_suppkey // 250) || '.' || (l_suppkey % 250) END AS orig_h,
    'L-' || l_orderkey || '-' || l_linenumber AS uid, 50000 AS orig_p, CAST(l_quantity AS DOUBLE) AS duration,
    CASE WHEN l_partkey % 11 = 0 THEN '10.2.' || (l_suppkey // 250) || '.' || (l_suppkey % 250)
         ELSE '10.3.' || (l_partkey // 250) || '.' || (l_partkey % 250) END AS resp_h,
    ['opc-ua','https','mssql','bacnet',NULL,'dns','s7comm',''][l_partkey % 8 + 1] AS service,
    CASE WHEN l_partkey % 8 = 7 THEN 'udp' ELSE 'tcp' END AS proto,
    [4840,443,1433,47808,8080,53,102,161][l_partkey % 8 + 1] AS port,
    1000000000000 + (l_orderkey * 8 + l_linenumber) * 10000 + (epoch_us(l_shipdate) - {SHIP0_US}) // 86400000000 AS seq
  FROM lineitem
), comm AS (
  SELECT ts_us, orig_h, resp_h,
         CASE WHEN log = 'conn' THEN coalesce(nullif(service, ''), proto) ELSE log END AS protocol, port,
         CASE log WHEN 'modbus' THEN func WHEN 'dnp3' THEN fc_request ELSE 'flow' END AS function_code, seq
  FROM plant
  UNION ALL
  SELECT ts_us, orig_h, resp_h, coalesce(nullif(service, ''), proto), port, 'flow', seq FROM flow
), folded AS (
  SELECT orig_h AS src_ip, resp_h AS dst_ip, protocol, port, function_code,
         min(ts_us) AS first_seen, max(ts_us) AS last_seen, count(*) AS packet_count
  FROM comm GROUP BY ALL
), edges AS (
  SELECT *, CASE WHEN packet_count > 1 THEN (last_seen - first_seen) / 1e3 / (packet_count - 1) ELSE 0e0 END AS avg_interval_ms,
    packet_count > 1 AND (last_seen - first_seen) / 1e3 / greatest(packet_count - 1, 1) BETWEEN 100 AND 1000 AS is_periodic
  FROM folded
), devices AS (
  SELECT ip, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
         CAST(NULL AS VARCHAR) AS mac, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS INTEGER) AS purdue_level
  FROM (SELECT src_ip AS ip, first_seen, last_seen FROM edges UNION ALL
        SELECT dst_ip, first_seen, last_seen FROM edges) GROUP BY ip
), zones AS (
  SELECT * FROM (VALUES {_values((z.name, z.purdue_level, z.description, z.sl_t) for z in catalog.ZONES)})
    v(name, purdue_level, description, sl_t)
), port_level AS (
  SELECT * FROM (VALUES {_values((p, n, lv) for (p, n), lv in catalog.PORT_LEVELS.items())}) v(protocol, port, level)
), name_level AS (
  SELECT * FROM (VALUES {_values(catalog.PROTOCOL_LEVELS.items())}) v(protocol, level)
), edge_level AS (
  SELECT e.*, least(p.level, n.level) AS level
  FROM edges e LEFT JOIN port_level p ON p.protocol = lower(e.protocol) AND p.port = e.port
               LEFT JOIN name_level n ON n.protocol = lower(e.protocol)
), device_level AS (
  SELECT src_ip AS ip, coalesce(min(level), 3) AS level FROM edge_level GROUP BY src_ip
), dz AS (
  SELECT ip, name AS zone_name FROM device_level JOIN zones ON purdue_level = level
), two AS (
  SELECT ip, zone_name FROM dz UNION SELECT ip, 'Field' FROM dz WHERE ip LIKE '%7'
), member AS (
  SELECT ip, name AS zone, purdue_level AS level FROM two JOIN zones ON zone_name = name
), pairs AS (
  SELECT e.*, s.zone AS src_zone, s.level AS src_level, d.zone AS dst_zone, d.level AS dst_level
  FROM edges e JOIN member s ON s.ip = e.src_ip JOIN member d ON d.ip = e.dst_ip
), deg AS (
  SELECT ip, CAST(sum(o) AS BIGINT) AS out_edges, CAST(sum(i) AS BIGINT) AS in_edges FROM (
    SELECT src_ip AS ip, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst_ip, 0, 1 FROM edges) GROUP BY ip
), zone_stats AS (
  SELECT name AS zone_name, purdue_level, count(ip) AS device_count,
         CAST(coalesce(sum(out_edges), 0) AS BIGINT) AS outbound_edges,
         CAST(coalesce(sum(in_edges), 0) AS BIGINT) AS inbound_edges
  FROM zones LEFT JOIN two ON zone_name = name LEFT JOIN deg USING (ip) GROUP BY name, purdue_level
), conduits AS (
  SELECT * FROM (VALUES {", ".join(
      "(" + ", ".join([_text(c.name), _text(c.src_zone), _text(c.dst_zone), str(c.sl_t), str(c.sl_a),
                       _list(c.allowed_protocols), str(c.bidirectional).lower()]) + ")" for c in catalog.CONDUITS)})
    v(name, src_zone, dst_zone, sl_t, sl_a, allowed_protocols, bidirectional)
), rule AS (
  SELECT * FROM (VALUES {_values((i, *r) for i, r in enumerate(catalog.ROLE_RULES))})
    v(idx, role, protocol, port, function_code, confidence)
), rule_hit AS (
  SELECT e.src_ip AS ip, r.idx, r.role, r.confidence FROM edges e JOIN rule r
    ON (r.protocol IS NULL OR r.protocol = lower(e.protocol)) AND (r.port IS NULL OR r.port = e.port)
   AND (r.function_code IS NULL OR r.function_code = upper(e.function_code))
), roles AS (
  SELECT ip, coalesce(role, 'unknown') AS role, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence
  FROM (SELECT DISTINCT src_ip AS ip FROM edges)
  LEFT JOIN (SELECT ip, role, confidence FROM rule_hit
             QUALIFY row_number() OVER (PARTITION BY ip ORDER BY confidence DESC, idx) = 1) USING (ip)
), named AS (
  SELECT d.ip, d.first_seen, d.last_seen, nullif(r.role, 'unknown') AS role FROM devices d LEFT JOIN roles r USING (ip)
), silence_s AS (
  SELECT * FROM (VALUES {_values(catalog.SILENCE_SECONDS.items())}) v(role, seconds)
), quiet AS (
  SELECT n.ip, n.role, n.last_seen, ({NOW} - n.last_seen) / 1e6 AS silent_for_s,
         CAST(coalesce(s.seconds, 600) AS DOUBLE) AS threshold_s
  FROM named n LEFT JOIN silence_s s ON s.role = lower(n.role)
), tactics AS (
  SELECT * FROM (VALUES {_values((i, *t[:3]) for i, t in enumerate(catalog.TACTICS))}) v(idx, tactic_id, name, description)
), techniques AS (
  SELECT * FROM (VALUES {", ".join(
      f"({i}, {_text(t.technique_id)}, {_text(t.name)}, {_text(t.tactic_id)}, {_list(t.detection_signals)})"
      for i, t in enumerate(catalog.TECHNIQUES))}) v(idx, technique_id, name, tactic_id, detection_signals)
), tech_signal AS (
  SELECT idx, technique_id, tactic_id, unnest(detection_signals) AS signal FROM techniques
), write_code AS (
  SELECT unnest({_list(catalog.WRITE_FUNCTION_CODES)}) AS code
), cat_signal AS (
  SELECT * FROM (VALUES {_values(catalog.CATEGORY_SIGNALS.items())}) v(category, signal)
), findings AS (
  SELECT 'cross_zone_violations' AS category, NULL AS ip, src_ip, dst_ip, protocol, port,
         CAST(NULL AS VARCHAR) AS function_code, packet_count, CAST(NULL AS DOUBLE) AS avg_interval_ms,
         src_zone, dst_zone FROM pairs WHERE abs(src_level - dst_level) > 1
  UNION ALL SELECT 'new_devices', ip, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM devices WHERE first_seen > {NEW}
  UNION ALL SELECT 'new_edges', NULL, src_ip, dst_ip, protocol, port, function_code, packet_count, NULL, NULL, NULL
            FROM edges WHERE first_seen > {NEW}
  UNION ALL SELECT 'interval_deviation', NULL, src_ip, dst_ip, protocol, port, function_code, packet_count, avg_interval_ms,
            NULL, NULL FROM edges WHERE packet_count > 1 AND (avg_interval_ms < 100 OR avg_interval_ms > 1000)
  UNION ALL SELECT 'unknown_protocol', NULL, src_ip, dst_ip, protocol, port, function_code, packet_count, NULL, NULL, NULL
            FROM edges WHERE protocol NOT IN {ALLOWED}
), base AS (
  SELECT src_ip AS ip, protocol, dst_ip, first_seen, last_seen, packet_count,
         CASE WHEN is_periodic AND avg_interval_ms <> 0 THEN avg_interval_ms END AS x,
         CASE WHEN last_seen > first_seen THEN packet_count / ((last_seen - first_seen) / 1e6 / 60) END AS rate
  FROM edges WHERE first_seen >= {T0_US} AND last_seen <= {T0_US + 60_000_000}
), profile AS (
  SELECT ip, avg(x) AS interval_mean, coalesce(stddev_pop(x), 0) AS interval_std,
         coalesce(avg(rate), 0) AS packet_rate_mean, coalesce(stddev_pop(rate), 0) AS packet_rate_std,
         array_to_string(list_sort(list(DISTINCT protocol)), '|') AS protocols, count(DISTINCT dst_ip) AS peer_count,
         count(x) AS periodic_edge_count, count(*) AS total_edges,
         CASE WHEN count(x) >= 4 THEN quantile_cont(x, 0.25) END AS q1,
         CASE WHEN count(x) >= 4 THEN quantile_cont(x, 0.75) END AS q3
  FROM base GROUP BY ip
), fences AS (
  SELECT *, q1 - 1.5 * (q3 - q1) AS iqr_lower, q3 + 1.5 * (q3 - q1) AS iqr_upper FROM profile
), observed AS (
  SELECT src_ip AS ip, avg(avg_interval_ms) AS observed_ms FROM edges WHERE is_periodic GROUP BY src_ip
), scored AS (
  SELECT ip, observed_ms, interval_mean, iqr_lower, iqr_upper,
         CASE WHEN interval_std < 1e-9 THEN 0 ELSE (observed_ms - coalesce(interval_mean, 0)) / interval_std END AS z,
         coalesce(observed_ms < iqr_lower OR observed_ms > iqr_upper, false) AS iqr_hit
  FROM observed JOIN fences USING (ip)
)
"""


def sql(body: str) -> str:
    return BASE + body

"""Column layouts shared by sources, operators and streams."""

from __future__ import annotations

from pyspark.sql import types as T

_ENDPOINTS = "ts timestamp, uid string, orig_h string, orig_p int, resp_h string, resp_p int"
_CONN_TAIL = (
    "proto string, service string, duration double, orig_bytes bigint, resp_bytes bigint, conn_state string, "
    "local_orig boolean, local_resp boolean, missed_bytes bigint, history string, orig_pkts bigint, "
    "orig_ip_bytes bigint, resp_pkts bigint, resp_ip_bytes bigint, tunnel_parents array<string>"
)


_KINDS = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    # Reading DDL needs a running session, which an import must not.
    pairs = [column.split() for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


EVENT_SCHEMAS = {
    "modbus": _struct(f"{_ENDPOINTS}, func string, exception string"),
    "dnp3": _struct(f"{_ENDPOINTS}, fc_request string, fc_reply string, iin bigint"),
    "conn": _struct(f"{_ENDPOINTS}, {_CONN_TAIL}"),
}

# Columns a record cannot do without; a record lacking one is rejected.
REQUIRED = {
    "modbus": ["ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "func"],
    "dnp3": ["ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "fc_request"],
    "conn": ["ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "conn_state"],
}

# One wide frame holds all three kinds, told apart by ``log``; columns that a
# kind does not have are null.  Scanning it once serves all three.
WIDE_EVENT = _struct(
    f"log string, {_ENDPOINTS}, func string, exception string, fc_request string, fc_reply string, iin bigint, "
    f"{_CONN_TAIL}"
)

EDGE_KEY = ["src_ip", "dst_ip", "protocol", "port", "function_code"]

EDGES = _struct(
    "src_ip string, dst_ip string, protocol string, port int, function_code string, first_seen timestamp, "
    "last_seen timestamp, packet_count bigint, avg_interval_ms double, is_periodic boolean"
)
DEVICES = _struct(
    "ip string, mac string, role string, purdue_level int, first_seen timestamp, last_seen timestamp, "
    "inferred_purdue_level int, role_confidence double"
)
DEVICE_ZONE = _struct("ip string, zone_name string")
BASELINE_FEED = _struct("ip string, ts bigint, protocol string, packet_count bigint, avg_interval_ms double")

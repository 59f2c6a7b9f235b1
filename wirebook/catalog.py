"""Zones, conduits, rules, thresholds, ATT&CK and signatures.

Everything in this module is configuration of known, small size.  Operators
take these lists as defaults and accept replacements of the same shape.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LOG_TYPES = ("modbus", "dnp3", "conn")
LOG_NAMES = ("modbus.log", "dnp3.log", "conn.log")
TOPIC_STEM = "raw."

# Default bounds of a regular polling interval, in milliseconds.
PERIODIC_MIN_MS = 100.0
PERIODIC_MAX_MS = 1000.0

DEFAULT_LEVEL = 3


class Zone(NamedTuple):
    name: str
    purdue_level: int
    description: str
    sl_t: int


# Fixed values.
ZONES = [
    Zone("Field", 0, "Physical process: sensors, actuators, drives", 2),
    Zone("Control", 1, "Process control: PLCs, RTUs, DCS controllers", 3),
    Zone("Supervisory", 2, "Supervisory control: HMI, SCADA servers", 3),
    Zone("Operations", 3, "Manufacturing operations: historian, MES, engineering workstations", 2),
    Zone("Business", 4, "Business logistics: ERP, business LAN", 1),
    Zone("Enterprise", 5, "Enterprise / internet-facing: DMZ, cloud connectivity", 1),
]


class Conduit(NamedTuple):
    name: str
    src_zone: str
    dst_zone: str
    sl_t: int = 2
    sl_a: int = 2
    allowed_protocols: list[str] = []
    bidirectional: bool = True


# Fixed values.
CONDUITS = [
    Conduit("Field-Control", "Field", "Control", 3, 2, ["modbus", "dnp3", "s7comm", "profibus"]),
    Conduit("Control-Supervisory", "Control", "Supervisory", 3, 3, ["modbus", "dnp3", "opc-da", "opc-ua"]),
    Conduit("Supervisory-Operations", "Supervisory", "Operations", 2, 2, ["opc-ua", "https", "historian"]),
    Conduit("Operations-Business", "Operations", "Business", 2, 2, ["https", "sql"]),
    Conduit("Business-Enterprise", "Business", "Enterprise", 1, 2, ["https"]),
]

# Fixed values: (protocol, port) -> Purdue level.
PORT_LEVELS = {
    ("modbus", 502): 1,
    ("dnp3", 20000): 1,
    ("s7comm", 102): 1,
    ("iec104", 2404): 1,
    ("enip", 44818): 1,
    ("ethernet/ip", 44818): 1,
    ("opc-ua", 4840): 2,
    ("bacnet", 47808): 2,
    ("mssql", 1433): 3,
    ("sql", 1433): 3,
    ("smb", 445): 4,
    ("cifs", 445): 4,
    ("rdp", 3389): 4,
    ("dns", 53): 5,
    ("ntp", 123): 5,
    ("http", 80): 5,
    ("https", 443): 5,
}

# Protocol -> Purdue level, whatever the port.
PROTOCOL_LEVELS = {
    "modbus": 1,
    "dnp3": 1,
    "s7comm": 1,
    "iec104": 1,
    "enip": 1,
    "opc-ua": 2,
    "opc-da": 2,
    "bacnet": 2,
    "mssql": 3,
    "sql": 3,
    "historian": 3,
    "smb": 4,
    "rdp": 4,
    "http": 5,
    "https": 5,
    "dns": 5,
    "ntp": 5,
}


class RoleRule(NamedTuple):
    """A role hint; ``None`` in a field means any value."""

    role: str
    protocol: str | None = None
    port: int | None = None
    function_code: str | None = None
    confidence: float = 0.7


UNKNOWN_ROLE = "unknown"

# Fixed values, in rule order: an earlier rule wins a tie in confidence.
ROLE_RULES = [
    RoleRule("plc", "s7comm", 102, None, 0.95),
    RoleRule("plc", "modbus", 502, "READ_HOLDING_REGISTERS", 0.85),
    RoleRule("plc", "modbus", 502, "WRITE_SINGLE_REGISTER", 0.85),
    RoleRule("plc", "modbus", 502, None, 0.75),
    RoleRule("rtu", "dnp3", 20000, None, 0.85),
    RoleRule("rtu", "dnp3", None, None, 0.75),
    RoleRule("rtu", "iec104", 2404, None, 0.85),
    RoleRule("plc", "enip", 44818, None, 0.85),
    RoleRule("plc", "ethernet/ip", None, None, 0.80),
    RoleRule("field_device", "bacnet", 47808, None, 0.75),
    RoleRule("scada", "opc-ua", 4840, None, 0.80),
    RoleRule("historian", "historian", None, None, 0.90),
    RoleRule("historian", "mssql", 1433, None, 0.75),
    RoleRule("historian", "sql", 1433, None, 0.70),
    RoleRule("engineering", "rdp", 3389, None, 0.75),
    RoleRule("hmi", "http", 80, None, 0.60),
    RoleRule("hmi", "https", 443, None, 0.60),
]

# Seconds without traffic before a device of a role is silent.
SILENCE_SECONDS = {
    "plc": 300,
    "rtu": 300,
    "hmi": 900,
    "scada": 600,
    "historian": 600,
    "engineering": 3600,
    "field_device": 300,
    "gateway": 600,
}
SILENCE_DEFAULT_SECONDS = 600

# Fixed values.
EXPECTED_PROTOCOLS = ["modbus", "dnp3", "s7comm", "iec104", "enip", "opc-ua", "bacnet"]
ALLOWED_PROTOCOLS = ["modbus", "dnp3", "s7comm", "tcp", "udp"]

# Function codes that write to a controller.
WRITE_FUNCTION_CODES = [
    "WRITE_SINGLE_COIL",
    "WRITE_MULTIPLE_COILS",
    "WRITE_SINGLE_REGISTER",
    "WRITE_MULTIPLE_REGISTERS",
    "WRITE_FILE_RECORD",
    "MASK_WRITE_REGISTER",
    "READ_WRITE_MULTIPLE_REGISTERS",
    "DIRECT_OPERATE",
    "SELECT",
    "DIRECT_OPERATE_NO_ACK",
    "FREEZE",
    "FREEZE_CLEAR",
]

# Finding category -> detection signal.
CATEGORY_SIGNALS = {
    "cross_zone_violations": "cross_zone_violation",
    "new_devices": "new_device",
    "new_edges": "new_edge",
    "interval_deviation": "interval_deviation",
    "unknown_protocol": "unknown_protocol",
    "silence": "silence_detection",
    "process_deviation": "process_deviation",
}


class Tactic(NamedTuple):
    tactic_id: str
    name: str
    description: str


# Fixed values (MITRE ATT&CK for ICS).
TACTICS = [
    Tactic("TA0108", "Initial Access", "Gain initial foothold into ICS environment"),
    Tactic("TA0104", "Execution", "Execute adversary-controlled code on ICS devices"),
    Tactic("TA0110", "Persistence", "Maintain foothold after process restarts or device reboots"),
    Tactic("TA0111", "Privilege Escalation", "Gain higher-level permissions in the ICS environment"),
    Tactic("TA0103", "Evasion", "Avoid detection by security tools or operators"),
    Tactic("TA0102", "Discovery", "Enumerate ICS assets, topology, and operational state"),
    Tactic("TA0109", "Lateral Movement", "Move through the ICS network to reach target assets"),
    Tactic("TA0100", "Collection", "Gather operational data for use in attacks"),
    Tactic("TA0101", "Command and Control", "Communicate with compromised ICS assets"),
    Tactic("TA0107", "Inhibit Response Function", "Prevent safety systems or protective functions from operating"),
    Tactic("TA0106", "Impair Process Control", "Manipulate, disable, or damage physical processes"),
    Tactic("TA0105", "Impact", "Manipulate, interrupt, or destroy physical systems"),
]


class Technique(NamedTuple):
    technique_id: str
    name: str
    tactic_id: str
    description: str
    detection_signals: list[str]


# Fixed values (MITRE ATT&CK for ICS), in catalogue order.
TECHNIQUES = [
    Technique("T0840", "Network Connection Enumeration", "TA0102",
              "Enumerate network connections and active sessions on ICS devices.",
              ["cross_zone_violation", "new_edge", "port_scan"]),
    Technique("T0846", "Remote System Discovery", "TA0102",
              "Discover remote systems and their roles in the ICS network.",
              ["new_device", "new_edge", "broadcast_traffic"]),
    Technique("T0888", "Remote System Information Discovery", "TA0102",
              "Collect information about remote systems via ICS protocols.",
              ["new_edge", "unknown_protocol", "function_code_enumeration"]),
    Technique("T0812", "Default Credentials", "TA0109",
              "Use default vendor credentials to authenticate to ICS devices.",
              ["new_edge", "cross_zone_violation"]),
    Technique("T0866", "Exploitation of Remote Services", "TA0109",
              "Exploit vulnerabilities in remote services on ICS devices.",
              ["cross_zone_violation", "new_edge", "unusual_function_code"]),
    Technique("T0802", "Automated Collection", "TA0100",
              "Automated collection of OT data using ICS protocol commands.",
              ["interval_deviation", "new_edge", "high_packet_rate"]),
    Technique("T0811", "Data from Information Repositories", "TA0100",
              "Collect data from historian, MES, or SCADA databases.",
              ["new_edge", "sql_traffic", "historian_query"]),
    Technique("T0803", "Block Command Message", "TA0107",
              "Block or drop ICS command messages to inhibit control.",
              ["silence_detection", "missing_poll"]),
    Technique("T0835", "Manipulate I/O Image", "TA0107",
              "Manipulate the I/O image in a PLC to prevent safety response.",
              ["unusual_function_code", "write_coil", "interval_deviation"]),
    Technique("T0836", "Modify Parameter", "TA0106",
              "Modify a device parameter to alter process behaviour.",
              ["unusual_function_code", "write_register", "new_edge"]),
    Technique("T0855", "Unauthorized Command Message", "TA0106",
              "Send unauthorized command messages to ICS devices.",
              ["cross_zone_violation", "unusual_function_code", "new_edge"]),
    Technique("T0858", "Change Credential", "TA0106",
              "Change credentials on ICS devices to maintain access.",
              ["new_edge", "unusual_function_code"]),
    Technique("T0826", "Loss of Availability", "TA0105",
              "Cause loss of availability of ICS devices or processes.",
              ["silence_detection", "interval_deviation"]),
    Technique("T0828", "Loss of Productivity and Revenue", "TA0105",
              "Cause disruptions that result in production downtime.",
              ["silence_detection", "interval_deviation", "process_deviation"]),
    Technique("T0831", "Manipulation of Control", "TA0105",
              "Cause controllers to respond in unexpected ways.",
              ["unusual_function_code", "interval_deviation", "write_register"]),
    Technique("T0820", "Rootkit", "TA0103",
              "Use rootkits to hide presence on ICS devices.",
              ["silence_detection", "unexpected_traffic_pattern"]),
    Technique("T0849", "Masquerading", "TA0103",
              "Disguise malicious activity as legitimate ICS traffic.",
              ["interval_deviation", "unknown_protocol"]),
    Technique("T0869", "Standard Application Layer Protocol", "TA0101",
              "Use ICS protocol channels for C2 communications.",
              ["cross_zone_violation", "unknown_protocol", "new_edge"]),
]


class Step(NamedTuple):
    protocol: str
    function_codes: list[str]
    source_role: str | None = None
    dest_role: str | None = None
    max_interval_ms: float = 5000.0


class Signature(NamedTuple):
    name: str
    steps: list[Step]
    tags: list[str] = []
    description: str = ""


# Fixed values.
SIGNATURES = [
    Signature(
        "ModbusPollCycle",
        [
            Step("modbus", ["READ_COILS", "READ_DISCRETE_INPUTS"], "hmi", "plc", 2000.0),
            Step("modbus", ["READ_HOLDING_REGISTERS", "READ_INPUT_REGISTERS"], "hmi", "plc", 2000.0),
        ],
        ["modbus", "poll", "plc"],
        "Standard Modbus polling: master reads discrete inputs/coils then holding registers from a PLC outstation.",
    ),
    Signature(
        "DNP3IntegrityPoll",
        [
            Step("dnp3", ["READ"], "scada", "rtu", 5000.0),
            Step("dnp3", ["RESPONSE"], "rtu", "scada", 5000.0),
        ],
        ["dnp3", "poll", "rtu"],
        "DNP3 integrity poll sequence: master requests Class 0 static data "
        "followed by Class 1/2/3 event data from RTU outstation.",
    ),
    Signature(
        "S7ProgramRead",
        [
            Step("s7comm", ["CPU_SERVICES", "SETUP_COMMUNICATION"], "engineering", "plc", 10000.0),
            Step("s7comm", ["READ_VAR", "REQUEST_DOWNLOAD"], "engineering", "plc", 10000.0),
        ],
        ["s7comm", "engineering", "plc"],
        "S7comm program read: engineering workstation reads CPU state and then fetches a data block from the PLC.",
    ),
    Signature(
        "EIPTagRead",
        [
            Step("enip", ["FORWARD_OPEN", "REGISTER_SESSION"], "hmi", "plc", 3000.0),
            Step("enip", ["GET_ATTRIBUTE_ALL", "GET_ATTRIBUTE_SINGLE", "READ_TAG"], "hmi", "plc", 3000.0),
        ],
        ["enip", "cip", "plc"],
        "EtherNet/IP tag read: HMI establishes a CIP connection via Forward Open then reads tag values from PLC.",
    ),
]

PARTIAL_MATCH_SCORE = 0.6
DEVIATION_THRESHOLD = 0.3


def local_frame(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A small table held in the plan itself, so that its size is known.

    Rows given as plain Python objects would become an RDD, whose size Spark
    does not know and would therefore not broadcast.
    """
    schema = T.StructType.fromDDL(ddl)
    records = [_record(row, schema) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(schema)), schema)


def _record(row, schema: T.StructType) -> dict:
    return {f.name: _value(v, f.dataType) for f, v in zip(schema, row)}


def _value(value, kind):
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return _record(value, kind)
    if isinstance(kind, T.ArrayType):
        return [_value(v, kind.elementType) for v in value]
    return value


def zones_frame(spark: SparkSession, zones: list[Zone] | None = None) -> DataFrame:
    return local_frame(
        spark,
        ZONES if zones is None else zones,
        "name string, purdue_level int, description string, sl_t int",
    )


def conduits_frame(spark: SparkSession, conduits: list[Conduit] | None = None) -> DataFrame:
    return local_frame(
        spark,
        CONDUITS if conduits is None else conduits,
        "name string, src_zone string, dst_zone string, sl_t int, sl_a int, "
        "allowed_protocols array<string>, bidirectional boolean",
    )


def tactics_frame(spark: SparkSession) -> DataFrame:
    return local_frame(spark, TACTICS, "tactic_id string, name string, description string")


def techniques_frame(spark: SparkSession) -> DataFrame:
    return local_frame(
        spark,
        TECHNIQUES,
        "technique_id string, name string, tactic_id string, description string, detection_signals array<string>",
    )


def signatures_frame(spark: SparkSession, signatures: list[Signature] | None = None) -> DataFrame:
    return local_frame(
        spark,
        SIGNATURES if signatures is None else signatures,
        "name string, steps array<struct<protocol:string,function_codes:array<string>,"
        "source_role:string,dest_role:string,max_interval_ms:double>>, tags array<string>, description string",
    )

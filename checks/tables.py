"""The driver's tables seen as OT traffic.

``events`` serves as protocol records (modbus, dnp3 and a few services) of a
small plant whose channels are polled, ``lineitem`` as flow records between
many suppliers and parts.  Everything is derived from the rows of the tables,
so the work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.operators import fold, roles, zones
from wirebook.schemas import WIDE_EVENT
from wirebook.sources.events import normalize
from wirebook.sources.tables import shared_dir

T0_US = 1704067200000000
SHIP0_US = 788918400000000
BASELINE_END_US = T0_US + 500_000
NOW_US = T0_US + 600_000_000

MODBUS_CODES = ["READ_COILS", "READ_HOLDING_REGISTERS", "WRITE_SINGLE_COIL", "DIAGNOSTICS"]
DNP3_CODES = ["READ", "RESPONSE", "SELECT"]


def at(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wall_us(column: str):
    """Microseconds of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def _wide(df: DataFrame, **columns) -> DataFrame:
    """Select the wide event columns, null where none is given."""
    return df.select(
        *[
            columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in WIDE_EVENT
        ],
        columns["ingest_seq"].cast("bigint").alias("ingest_seq"),
    )


def plant_events(events: DataFrame) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    rows = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    a = F.concat(F.lit("10.0.0."), (F.col("user_id") % 12).cast("string"))
    b = F.concat(F.lit("10.1.0."), (k % 4).cast("string"))
    swapped = k % 5 == 0
    step = F.when(F.col("user_id") % 3 == 0, 30000).when(F.col("user_id") % 3 == 1, 300000).otherwise(3000000)
    ts = F.timestamp_micros((F.lit(T0_US) + F.floor((wall_us("ts") - T0_US) / step)).cast("bigint"))
    log = F.when(kind == "click", "modbus").when(kind == "view", "dnp3").otherwise("conn")
    port = F.when(kind == "click", 502).when(kind == "view", 20000).when(kind == "purchase", 4840).when(
        kind == "signup", 443
    ).otherwise(445)
    service = F.when(kind == "purchase", "opc-ua").when(kind == "signup", "https").when(kind == "error", "smb")

    def code(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(k / 4) % len(values) + 1).cast("int"))

    conn = log == "conn"
    return _wide(
        rows,
        log=log,
        ts=ts,
        uid=F.concat(F.lit("C"), F.col("event_id").cast("string")),
        orig_h=F.when(swapped, b).otherwise(a),
        orig_p=40000 + k,
        resp_h=F.when(swapped, a).otherwise(b),
        resp_p=port,
        func=F.when(log == "modbus", code(MODBUS_CODES)),
        exception=F.when((log == "modbus") & (k % 7 == 0), "ILLEGAL_FUNCTION"),
        fc_request=F.when(log == "dnp3", code(DNP3_CODES)),
        fc_reply=F.when((log == "dnp3") & (k % 3 == 0), "RESPONSE"),
        iin=F.when((log == "dnp3") & (k % 2 == 0), k * 10),
        proto=F.when(conn, "tcp"),
        service=service,
        duration=F.when(conn, F.col("value")),
        orig_bytes=F.when(conn, k * 100),
        conn_state=F.when(conn, "SF"),
        local_orig=F.when(conn, k % 2 == 0),
        tunnel_parents=F.when(conn & (k % 4 == 0), F.array(F.concat(F.lit("p"), k.cast("string")))),
        ingest_seq=F.col("event_id"),
    )


def flow_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    supplier, part = F.col("l_suppkey"), F.col("l_partkey")
    a = F.concat(F.lit("10.2."), F.floor(supplier / 250).cast("string"), F.lit("."), (supplier % 250).cast("string"))
    b = F.concat(F.lit("10.3."), F.floor(part / 250).cast("string"), F.lit("."), (part % 250).cast("string"))
    swapped = part % 11 == 0
    step = F.when(supplier % 2 == 0, 140000000).otherwise(14000000)
    shipped = wall_us("l_shipdate") - SHIP0_US
    service = F.array(
        *[F.lit(v) for v in ["opc-ua", "https", "mssql", "bacnet", None, "dns", "s7comm", ""]]
    )
    ports = F.array(*[F.lit(v) for v in [4840, 443, 1433, 47808, 8080, 53, 102, 161]])
    pick = (part % 8 + 1).cast("int")
    day = F.floor(shipped / 86400000000)
    return _wide(
        rows,
        log=F.lit("conn"),
        ts=F.timestamp_micros((F.lit(T0_US) + F.floor(shipped / step)).cast("bigint")),
        uid=F.concat_ws("-", F.lit("L"), F.col("l_orderkey"), F.col("l_linenumber")),
        orig_h=F.when(swapped, b).otherwise(a),
        orig_p=F.lit(50000),
        resp_h=F.when(swapped, a).otherwise(b),
        resp_p=F.element_at(ports, pick),
        proto=F.when(pick == 8, "udp").otherwise("tcp"),
        service=F.element_at(service, pick),
        duration=F.col("l_quantity"),
        conn_state=F.lit("SF"),
        ingest_seq=F.lit(1000000000000) + (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10000 + day,
    )


#: Events in a file of a stream, about; a file is read by one task.
FILE_ROWS = 100_000


def files_per_batch(rows: int, batches: int) -> int:
    """Files in a batch, so that the tasks of a batch grow with the rows and a task does not."""
    return max(1, -(-rows // (batches * FILE_ROWS)))


def events_stream(spark: SparkSession, sf: str, batches: int = 1) -> DataFrame:
    """The events table as a file stream, in one batch or dealt out over several."""
    events = table(spark, sf, "events")
    schema = events.schema
    if batches > 1:
        path, files = shared_dir(spark), files_per_batch(events.count(), batches)
        events.repartition(batches * files, "event_id").write.parquet(path)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


FIELDS = {
    "modbus": ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "func", "exception"],
    "dnp3": ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "fc_request", "fc_reply", "iin"],
    "conn": ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration",
             "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp", "missed_bytes", "history",
             "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "tunnel_parents"],
}
# Logs by number: kind, separator, its declaration, unset sentinel.
LOGS = [
    ("modbus", "\t", "\\x09", "-"),
    ("modbus", "|", "\\x7c", "~"),
    ("dnp3", "\t", "\\x09", "-"),
    ("conn", "\t", "\\x09", "-"),
    ("conn", "\t", "\\x09", "-"),
    ("http", "\t", "\\x09", "-"),
]
#: Log 4 is closed before this share of the last event number.
CLOSE_SHARE = 0.9


def zeek_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The events written as lines of six Zeek logs, with faults in them.

    Every 17th k lacks a field, every 20th has a bad port, log 4 is closed
    after nine tenths of the events, log 5 is of a kind that is not read.
    """
    k = F.col("k")
    log_no = (F.col("user_id") % 6).cast("int")
    rows = table(spark, sf, "events").select(
        "event_id", "value", log_no.alias("log_no"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        wall_us("ts").alias("us"), "user_id",
    )

    def text(column):
        return column.cast("string")

    def choose(*values):
        return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))

    unset = F.element_at(F.array(*[F.lit(x[3]) for x in LOGS]), F.col("log_no") + 1)
    common = [
        F.concat(text(F.floor(F.col("us") / 1000000)), F.lit("."), F.lpad(text(F.col("us") % 1000000), 6, "0")),
        F.concat(F.lit("C"), text(F.col("event_id"))),
        F.concat(F.lit("10.0.0."), text(F.col("user_id") % 12)),
        F.when(k % 20 == 0, "x").otherwise(text(40000 + k)),
        F.concat(F.lit("10.1.0."), text(k % 4)),
        F.lit("502"),
    ]
    last = k % 17 == 0
    modbus = [*common, F.lit("READ_COILS"), F.when(k % 7 == 0, "ILLEGAL_FUNCTION").otherwise(unset)]
    dnp3 = [*common, F.when(k % 9 == 0, "-").otherwise("READ"), choose("-", "RESPONSE"), choose("-", "1.5", text(k))]
    conn = [
        *common, F.lit("tcp"), choose("-", "", "modbus"), F.when(k % 5 == 0, "1.0d").otherwise(text(F.col("value"))),
        F.when(k % 11 == 0, "").otherwise(text(k * 100)), F.lit("-"), F.lit("SF"), choose("T", "F", "t", "-"), F.lit("T"),
        F.lit("0"), F.lit("ShADadFf"), text(k), text(k * 60), F.lit("3"), F.lit("180"),
        choose("-", "(empty)", "a,b", F.concat(F.lit("u"), text(k))),
    ]

    def line(values):
        return F.when(last, F.concat_ws("\t", *values[:-1])).otherwise(F.concat_ws("\t", *values))

    tabbed = F.when(F.col("log_no").isin(0, 1, 5), line(modbus)).when(F.col("log_no") == 2, line(dnp3)).otherwise(line(conn))
    content = F.when(F.col("log_no") == 1, F.translate(tabbed, "\t", "|")).otherwise(tabbed)
    data = rows.select("log_no", (F.col("event_id") + 100).alias("line_no"), content.alias("line"))
    headers = []
    for kind, s, declared, dash in LOGS:
        fields = FIELDS.get(kind, FIELDS["modbus"])
        headers.append(F.array(*[F.lit(x) for x in [
            f"#separator {declared}", f"#set_separator{s},", f"#empty_field{s}(empty)", f"#unset_field{s}{dash}",
            f"#path{s}{kind}", s.join(["#fields", *fields]),
        ]]))
    header = F.element_at(F.array(*headers), F.col("log_no") + 1)
    top = data.select("log_no").distinct().select("log_no", F.posexplode(header).alias("line_no", "line"))
    last_line = F.floor(F.max(F.col("line_no") - 100) * CLOSE_SHARE) + 100
    close = data.groupBy().agg(last_line.alias("line_no"), F.max(F.when(F.col("log_no") == 4, 4)).alias("log_no"))
    close = close.where("log_no = 4").select("log_no", "line_no", F.lit("#close\t2024").alias("line"))
    lines = data.unionByName(top).unionByName(close)
    return lines.select(
        F.concat(F.lit("log"), text(F.col("log_no"))).alias("file"), F.lit(0).alias("log_rank"),
        F.col("line_no").cast("bigint").alias("line_no"), "line",
    )


_STORED: dict[tuple[str, str, str], str] = {}


@dataclass(frozen=True)
class Plant:
    """Lazily derived tables for one scale factor."""

    spark: SparkSession
    sf: str

    @cached_property
    def events(self) -> DataFrame:
        return plant_events(table(self.spark, self.sf, "events")).unionByName(flow_events(self.spark, self.sf))

    @cached_property
    def comm(self) -> DataFrame:
        return normalize(self.events)

    @cached_property
    def folded(self) -> DataFrame:
        """Edges straight from the events, for the queries about the fold."""
        return fold.fold_edges(self.comm)

    @cached_property
    def edges(self) -> DataFrame:
        """The edge table as the other queries find it: folded and written.

        It is written once per application and scale, to the shared folder,
        so that a query that uses edges several times reads the events once.
        """
        return self.stored("edges", lambda: self.folded)

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf, name)
        if key not in _STORED:
            path = shared_dir(self.spark)
            make().write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    @cached_property
    def devices(self) -> DataFrame:
        """The device table, stored like the edges it comes from, as the pipeline does."""
        return self.stored("devices", lambda: fold.fold_devices(self.edges))

    @cached_property
    def zones(self) -> DataFrame:
        return catalog.zones_frame(self.spark)

    @cached_property
    def conduits(self) -> DataFrame:
        return catalog.conduits_frame(self.spark)

    @cached_property
    def device_zone(self) -> DataFrame:
        """Zones of devices, stored like the edges they come from, as the pipeline does."""
        return self.stored("device_zone", lambda: zones.auto_assign_zones(self.edges, self.zones))

    @cached_property
    def two_zones(self) -> DataFrame:
        """Memberships with a second zone for devices ending in 7, stored, so that joins know their size."""
        extra = self.device_zone.where(F.col("ip").endswith("7")).select("ip", F.lit("Field").alias("zone_name"))
        return self.stored("two_zones", lambda: self.device_zone.unionByName(extra).dropDuplicates(["ip", "zone_name"]))

    @cached_property
    def roles(self) -> DataFrame:
        seen = self.edges.select(F.col("src_ip").alias("ip"), "protocol", "port", "function_code")
        return roles.fingerprint(seen)

    @cached_property
    def devices_with_roles(self) -> DataFrame:
        known = self.roles.where(F.col("role") != catalog.UNKNOWN_ROLE).select("ip", "role")
        return fold.fold_devices(self.edges, inventory=known)

    @cached_property
    def feed(self) -> DataFrame:
        """Device measurements for the windows, on the plain clock."""
        k = F.get_json_object("props", "$.k").cast("int")
        return table(self.spark, self.sf, "events").select(
            F.concat(F.lit("10.0.0."), (F.col("user_id") % 12).cast("string")).alias("ip"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("protocol"),
            (k % 10 + 1).cast("bigint").alias("packet_count"),
            F.col("value").alias("avg_interval_ms"),
        )

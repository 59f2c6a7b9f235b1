"""Registered queries: log lines, messages, streams and scalar functions."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from checks.registry import add, rounded
from checks.tables import CLOSE_SHARE, T0_US, Plant, at, events_stream, plant_events, table, wall_us, zeek_lines
from wirebook.functions import casts, stats
from wirebook.functions.once import compute_once
from wirebook.operators import fold
from wirebook.schemas import EVENT_SCHEMAS
from wirebook.sources import messages, tables
from wirebook.sources.events import normalize, of_type
from wirebook.sources.zeek import parse_lines, read_zeek
from wirebook.streaming import consume, late, monitor, silence

EDGE = "src_ip, dst_ip, protocol, port, function_code"

# ---------------------------------------------------------------- log lines

LINES = f""", ln AS (SELECT *, user_id % 6 AS log_no FROM ev WHERE user_id % 6 <> 4 OR event_id < (SELECT floor(max(event_id) * CAST({CLOSE_SHARE} AS DOUBLE)) FROM ev)),
  ok AS (SELECT *, us AS ts, 'C' || event_id AS uid, '10.0.0.' || (user_id % 12) AS orig_h, 40000 + k AS orig_p,
    '10.1.0.' || (k % 4) AS resp_h, 502 AS resp_p FROM ln WHERE k % 17 <> 0 AND k % 20 <> 0)
"""
COMMON = "ts, uid, orig_h, orig_p, resp_h, resp_p"


def _parsed(p: Plant):
    return parse_lines(zeek_lines(p.spark, p.sf))


def _headers(p: Plant) -> DataFrame:
    return _parsed(p).parsed.groupBy("file", "log").agg(F.count("*").alias("lines"), F.count("reason").alias("rejected"))


def _log_tree(p: Plant) -> str:
    """The same lines as files below one folder, a file for each log."""
    path = tables.shared_dir(p.spark)
    lines = zeek_lines(p.spark, p.sf).repartition("file").sortWithinPartitions("file", "line_no")
    lines.select("file", "line").write.partitionBy("file").text(path)
    return path


add("SRC-1", lambda p: read_zeek(p.spark, _log_tree(p), ("part-*",)).parsed.select(
        F.regexp_extract("file", "file=(log[0-9])", 1).alias("file"), "log", F.regexp_extract("line", "C([0-9]+)", 1).cast("bigint").alias("event_id"),
        "reason", "ts", "orig_h", "resp_p"),
    LINES + """SELECT 'log' || log_no AS file, ['modbus','modbus','dnp3','conn','conn'][log_no + 1] AS log, event_id,
      CASE WHEN k % 17 = 0 THEN 'field_count' WHEN k % 20 = 0 THEN 'bad_value' END AS reason, us AS ts, '10.0.0.' || (user_id % 12) AS orig_h, 502 AS resp_p
    FROM ln WHERE log_no < 5""")
add("SRC-2", _headers,
    LINES + """SELECT 'log' || log_no AS file, ['modbus','modbus','dnp3','conn','conn'][log_no + 1] AS log, count(*) AS lines,
      count(*) FILTER (k % 17 = 0 OR k % 20 = 0) AS rejected FROM ln WHERE log_no < 5 GROUP BY ALL""")
add("SRC-3", lambda p: _parsed(p).rejected.select("file", "log", F.regexp_extract("line", "C([0-9]+)", 1).cast("bigint").alias("event_id"), "reason"),
    LINES + """SELECT 'log' || log_no AS file, ['modbus','modbus','dnp3','conn','conn'][log_no + 1] AS log, event_id,
      CASE WHEN k % 17 = 0 THEN 'field_count' ELSE 'bad_value' END AS reason FROM ln WHERE log_no < 5 AND (k % 17 = 0 OR k % 20 = 0)""")
add("SRC-4", lambda p: of_type(_parsed(p).events, "modbus"),
    LINES + f"SELECT {COMMON}, 'READ_COILS' AS func, CASE WHEN k % 7 = 0 THEN 'ILLEGAL_FUNCTION' END AS exception FROM ok WHERE log_no IN (0, 1)")
add("SRC-5", lambda p: of_type(_parsed(p).events, "dnp3"),
    LINES + f"""SELECT {COMMON}, CASE WHEN k % 9 = 0 THEN '-' ELSE 'READ' END AS fc_request, CASE WHEN k % 2 = 1 THEN 'RESPONSE' END AS fc_reply,
      CASE WHEN k % 3 = 2 THEN CAST(k AS BIGINT) END AS iin FROM ok WHERE log_no = 2""")
CONN = LINES + f"""SELECT {COMMON}, 'tcp' AS proto, CASE k % 3 WHEN 1 THEN '' WHEN 2 THEN 'modbus' END AS service,
  CASE WHEN k % 5 <> 0 THEN value END AS duration, CASE WHEN k % 11 <> 0 THEN CAST(k * 100 AS BIGINT) END AS orig_bytes,
  CAST(NULL AS BIGINT) AS resp_bytes, 'SF' AS conn_state, CASE WHEN k % 4 <> 3 THEN k % 4 = 0 END AS local_orig, true AS local_resp,
  CAST(0 AS BIGINT) AS missed_bytes, 'ShADadFf' AS history, CAST(k AS BIGINT) AS orig_pkts, CAST(k * 60 AS BIGINT) AS orig_ip_bytes,
  CAST(3 AS BIGINT) AS resp_pkts, CAST(180 AS BIGINT) AS resp_ip_bytes,
  CASE k % 4 WHEN 1 THEN '' WHEN 2 THEN 'a|b' WHEN 3 THEN 'u' || k END AS tunnel_parents FROM ok WHERE log_no IN (3, 4)"""
add("SRC-6", lambda p: of_type(_parsed(p).events, "conn"), CONN)
add("PRJ-1", lambda p: of_type(_parsed(p).events, "conn").groupBy("service").agg(F.count("*").alias("n")),
    CONN.replace("SELECT ts, uid", ", c AS (SELECT ts, uid", 1) + ") SELECT service, count(*) AS n FROM c GROUP BY service")
add("PRJ-2", lambda p: table(p.spark, p.sf, "events").select("event_id", casts.to_ts(F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(
        F.concat((wall_us("ts") / 1000000).cast("decimal(20,6)").cast("string"), F.when(F.col("event_id") % 2 == 0, "0").otherwise("")))).alias("ts")),
    "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN us END AS ts FROM ev")
K_TEXT = "CASE event_id % 6 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN k || '.5' WHEN 3 THEN ' ' || k || ' ' WHEN 4 THEN '+' || k ELSE k || 'd' END"


def _texts(p: Plant) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    pick = (F.col("event_id") % 6 + 1).cast("int")
    texts = F.array(F.lit("-"), F.lit(""), F.concat(k, F.lit(".5")), F.concat(F.lit(" "), k, F.lit(" ")), F.concat(F.lit("+"), k), F.concat(k, F.lit("d")))
    return table(p.spark, p.sf, "events").select("event_id", F.element_at(texts, pick).alias("x"))


add("PRJ-3", lambda p: _texts(p).select("event_id", casts.to_int(F.col("x"), F.lit("-")).alias("v")),
    "SELECT event_id, CASE WHEN event_id % 6 IN (3, 4) THEN CAST(k AS BIGINT) END AS v FROM ev")
add("PRJ-4", lambda p: _texts(p).select("event_id", casts.to_float(F.col("x"), F.lit("-")).alias("v")),
    "SELECT event_id, CASE WHEN event_id % 6 IN (3, 4) THEN CAST(k AS DOUBLE) WHEN event_id % 6 = 2 THEN k + CAST(0.5 AS DOUBLE) END AS v FROM ev")
add("PRJ-5", lambda p: of_type(_parsed(p).events, "conn").groupBy("local_orig").agg(F.count("*").alias("n")),
    LINES + "SELECT CASE WHEN k % 4 <> 3 THEN k % 4 = 0 END AS local_orig, count(*) AS n FROM ok WHERE log_no IN (3, 4) GROUP BY ALL")
add("PRJ-6", lambda p: of_type(_parsed(p).events, "conn").select("uid", F.size("tunnel_parents").alias("n"), "tunnel_parents"),
    LINES + """SELECT uid, CASE k % 4 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 1 END AS n,
      CASE k % 4 WHEN 1 THEN '' WHEN 2 THEN 'a|b' WHEN 3 THEN 'u' || k END AS tunnel_parents FROM ok WHERE log_no IN (3, 4)""")
add("PRJ-8", lambda p: table(p.spark, p.sf, "events").select("event_id", casts.parse_iso_ts(
        F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                 F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("+02:00"), F.lit("?")), (F.col("event_id") % 4 + 1).cast("int")))).alias("ts")),
    "SELECT event_id, CASE event_id % 4 WHEN 2 THEN us - 7200000000 WHEN 3 THEN NULL ELSE us END AS ts FROM ev")

# ---------------------------------------------------------------- messages


def _ts_text(us: str) -> str:
    return f"(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 <> 0 THEN '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00')"


def _q(x: str) -> str:
    return f"coalesce('\"' || {x} || '\"', 'null')"


ENDS = (f"'{{\"ts\":\"' || {_ts_text('ts_us')} || '\",\"uid\":\"' || uid || '\",\"orig_h\":\"' || orig_h || '\",\"orig_p\":' || orig_p || "
        "',\"resp_h\":\"' || resp_h || '\",\"resp_p\":' || port")
JSON_MODBUS = f"{ENDS} || ',\"func\":\"' || func || '\",\"exception\":' || {_q('exception')} || '}}'".replace("}}", "}")
JSON_DNP3 = (f"{ENDS} || ',\"fc_request\":\"' || fc_request || '\",\"fc_reply\":' || {_q('fc_reply')} || ',\"iin\":' || "
             "coalesce(CAST(iin AS VARCHAR), 'null') || '}'")


def _json_conn(**values: str) -> str:
    """A conn message; fields not given are null."""
    names = EVENT_SCHEMAS["conn"].names[6:]
    return f"{ENDS} || '" + "".join(f',"{n}":' + (f"' || coalesce({values[n]}, 'null') || '" if n in values else "null") for n in names) + "}'"


def _quoted(x: str) -> str:
    return f"'\"' || {x} || '\"'"


PLANT_CONN = _json_conn(proto=_quoted("proto"), service=_quoted("service"), duration="CAST(duration AS VARCHAR)", orig_bytes="CAST(orig_bytes AS VARCHAR)",
                        conn_state=_quoted("'SF'"), local_orig="CAST(local_orig AS VARCHAR)", tunnel_parents="'[\"' || tunnel_parents || '\"]'")
FLOW_CONN = _json_conn(proto=_quoted("proto"), service=_quoted("service"), duration="CAST(duration AS VARCHAR)", conn_state=_quoted("'SF'"))
add("SRC-7", lambda p: messages.to_messages(p.events),
    f"""SELECT 'raw.' || log AS topic, orig_h || ':' || resp_h AS key,
      CASE log WHEN 'modbus' THEN {JSON_MODBUS} WHEN 'dnp3' THEN {JSON_DNP3} ELSE {PLANT_CONN} END AS value FROM plant
    UNION ALL SELECT 'raw.conn', orig_h || ':' || resp_h, {FLOW_CONN} FROM flow""")
add("SRC-8", lambda p: messages.to_messages(p.events, "site1.").groupBy("topic").agg(F.count("*").alias("n")),
    "SELECT 'site1.raw.' || log AS topic, count(*) AS n FROM (SELECT log FROM plant UNION ALL SELECT 'conn' FROM flow) GROUP BY ALL")


def _sink(p: Plant) -> DataFrame:
    path = tables.shared_dir(p.spark)
    messages.write_messages(messages.to_messages(p.events, sequence="ingest_seq"), path)
    rows = p.spark.read.parquet(path)
    # Places in a file against places by number: equal if every file keeps the order of its channels.
    file, at = F.col("_metadata.file_path"), F.monotonically_increasing_id()
    rows = rows.select("topic", "key", "seq", file.alias("file"), at.alias("at"))
    step = Window.partitionBy("file", "topic", "key").orderBy("at")
    rows = rows.withColumn("back", F.col("seq") < F.lag("seq").over(step))
    return rows.groupBy("topic", "key").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"),
                                            F.count_distinct("seq").alias("numbers"), F.count_if("back").alias("out_of_order"))


add("SRC-9", _sink,
    """SELECT 'raw.' || log AS topic, orig_h || ':' || resp_h AS key, count(*) AS n, min(seq) AS first, max(seq) AS last,
      count(DISTINCT seq) AS numbers, 0 AS out_of_order FROM (
      SELECT log, orig_h, resp_h, seq FROM plant UNION ALL SELECT 'conn', orig_h, resp_h, seq FROM flow) GROUP BY ALL""")


def _restored(p: Plant) -> DataFrame:
    """Every channel read back: its rows, and those that do not follow the one before."""
    path = tables.shared_dir(p.spark)
    messages.write_messages(messages.to_messages(p.events, sequence="ingest_seq"), path)
    rows = messages.read_messages(p.spark, path).withColumn("at", F.monotonically_increasing_id())
    step = Window.partitionBy("topic", "key").orderBy("at")
    rows = rows.withColumn("back", F.col("seq") < F.lag("seq").over(step))
    return rows.groupBy("topic", "key").agg(F.count("*").alias("n"), F.count_if("back").alias("out_of_order"))


add("SRC-9-order", _restored,
    """SELECT 'raw.' || log AS topic, orig_h || ':' || resp_h AS key, count(*) AS n, 0 AS out_of_order FROM (
      SELECT log, orig_h, resp_h FROM plant UNION ALL SELECT 'conn', orig_h, resp_h FROM flow) GROUP BY ALL""")


def _faulty(p: Plant, prefix: str = "dev.") -> DataFrame:
    """Messages of the plant, some of them broken in one of five ways."""
    sent = messages.to_messages(plant_events(table(p.spark, p.sf, "events")), prefix)
    return _broken(sent, prefix)


def _broken(sent: DataFrame, prefix: str) -> DataFrame:
    sent = compute_once(sent, value=F.col("value"))
    sent = compute_once(sent, number=F.regexp_extract("value", '"uid":"C([0-9]+)"', 1).cast("bigint"))
    number, way = F.col("number"), F.col("number") % 20
    value = F.col("value")
    return sent.select(
        F.when(way == 0, prefix + "raw.other").otherwise(F.col("topic")).alias("topic"),
        "key",
        F.when(way == 1, F.substring(value, 1, 40))
        .when(way == 2, F.regexp_replace(value, '"orig_p":', '"orig_q":'))
        .when(way == 3, F.regexp_replace(value, '"resp_p":[0-9]+', '"resp_p":"abc"'))
        .when(way == 4, F.regexp_replace(value, '"resp_p":([0-9]+)', '"resp_p":"$1"'))
        .when(way == 5, F.regexp_replace(value, "[+]00:00", ""))
        .when(way == 6, F.regexp_replace(value, '"ts":"[^"]*"', '"ts":"yesterday"'))
        .otherwise(value)
        .alias("value"),
        number.alias("event_id"),
    )


GOOD = "event_id % 20 NOT IN (0, 1, 2, 3, 6)"
add("SRC-10", lambda p: messages.good(messages.decode_messages(_faulty(p), "dev.")).select(
        "event_id", "log", "ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "func", "exception", "fc_request", "fc_reply", "iin",
        "proto", "service", "duration", "orig_bytes", "local_orig", "tunnel_parents"),
    f"""SELECT event_id, log, ts_us AS ts, uid, orig_h, orig_p, resp_h, port AS resp_p, func, exception, fc_request, fc_reply, iin, proto, service,
      duration, orig_bytes, local_orig, tunnel_parents FROM plant WHERE {GOOD}""")
REASONS = """SELECT event_id, CASE event_id % 20 WHEN 0 THEN 'unknown_topic' WHEN 1 THEN 'bad_json' WHEN 2 THEN 'missing_field' ELSE 'bad_value' END AS reason
  FROM plant WHERE event_id % 20 IN (0, 1, 2, 3, 6)"""
add("SRC-10-dead", lambda p: messages.decode_messages(_faulty(p), "dev.").where("reason IS NOT NULL").select("event_id", "reason"), REASONS)
add("FN-A", lambda p: messages.to_messages(plant_events(table(p.spark, p.sf, "events")))
        .select(F.json_object_keys("value").alias("keys")).groupBy("keys").agg(F.count("*").alias("n"))
        .select(F.size("keys").alias("fields"), "n"),
    "SELECT CASE log WHEN 'modbus' THEN 8 WHEN 'dnp3' THEN 9 ELSE 21 END AS fields, count(*) AS n FROM plant GROUP BY ALL")
add("FN-D", lambda p: p.devices.select("ip", casts.iso_utc(F.col("first_seen")).alias("first_seen"),
        ((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6).alias("seconds")),
    f"SELECT ip, {_ts_text('first_seen')} AS first_seen, (last_seen - first_seen) / 1e6 AS seconds FROM devices")
add("FN-M", lambda p: rounded(p.edges.select(*fold.EDGE_KEY, stats.sigmoid((F.col("packet_count") - 3).cast("double")).alias("s"),
        F.log1p("packet_count").alias("l")), "s", "l"),
    f"SELECT {EDGE}, round(1 / (1 + exp(3 - packet_count)), 6) AS s, round(ln(1 + packet_count), 6) AS l FROM edges")
add("FN-S", lambda p: p.edges.groupBy(F.upper(F.trim("protocol")).alias("p"), F.split("dst_ip", "[.]")[1].alias("net"),
        F.lower("function_code").contains("read").alias("reads")).agg(F.count("*").alias("n")),
    "SELECT upper(trim(protocol)) AS p, string_split(dst_ip, '.')[2] AS net, contains(lower(function_code), 'read') AS reads, count(*) AS n FROM edges GROUP BY ALL")

# ----------------------------------------------------------------- streams

#: Some of the plant's devices and edges are first seen after this.
EARLY_END_US = T0_US + 2_000

PLANT_EDGES = """, pe AS (SELECT orig_h AS src_ip, resp_h AS dst_ip, CASE WHEN log = 'conn' THEN service ELSE log END AS protocol, port,
    CASE log WHEN 'modbus' THEN func WHEN 'dnp3' THEN fc_request ELSE 'flow' END AS function_code,
    min(ts_us) AS first_seen, max(ts_us) AS last_seen, count(*) AS packet_count FROM plant WHERE {where} GROUP BY ALL)
  SELECT *, CASE WHEN packet_count > 1 THEN (last_seen - first_seen) / 1e3 / (packet_count - 1) ELSE 0e0 END AS avg_interval_ms,
    packet_count > 1 AND (last_seen - first_seen) / 1e3 / greatest(packet_count - 1, 1) BETWEEN 100 AND 1000 AS is_periodic FROM pe"""


def _consumed(p: Plant) -> str:
    """Run the consumer over the events table and return its folder."""
    root = tables.shared_dir(p.spark)
    sent = _broken(messages.to_messages(plant_events(events_stream(p.spark, p.sf, 3)), "dev."), "dev.")
    query = consume.start_consumer(sent, root, f"{root}/checkpoint", "dev.", available_now=True, compact_every=2)
    query.awaitTermination()
    return root


def _stream(p: Plant, df: DataFrame, mode: str, batches: int = 0) -> DataFrame:
    """Run a stream to its end, or for some batches, into files and read them back."""
    root = tables.shared_dir(p.spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    writer = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")
    if batches:
        run_on(writer.trigger(processingTime="100 milliseconds").start(), batches)
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    return p.spark.read.parquet(f"{root}/out")


def run_on(query: StreamingQuery, batches: int) -> None:
    """Wait for so many batches, then stop; a query with timers has no end of its own."""
    try:
        while query.isActive and (query.lastProgress or {"batchId": -1})["batchId"] < batches:
            time.sleep(0.1)
    finally:
        failure = query.exception()
        query.stop()
    if failure:
        raise failure


def _comm_stream(p: Plant) -> DataFrame:
    return normalize(plant_events(events_stream(p.spark, p.sf, 3)).withWatermark("ts", "10 minutes"))


add("STR-1", lambda p: tables.read_edges(p.spark, f"{_consumed(p)}/edges"), PLANT_EDGES.format(where=GOOD))
add("SRC-18", lambda p: tables.read_edges(p.spark, f"{_consumed(p)}/edges").agg(
        F.count("*").alias("edges"), F.sum("packet_count").alias("packets")),
    PLANT_EDGES.format(where=GOOD).replace("SELECT *, CASE", ", f AS (SELECT *, CASE") +
    ") SELECT count(*) AS edges, CAST(sum(packet_count) AS BIGINT) AS packets FROM f")


def _last_state(p: Plant) -> DataFrame:
    out = _stream(p, monitor.running_edges(_comm_stream(p)), "update")
    newest = F.max_by(F.struct("first_seen", "last_seen", "packet_count", "avg_interval_ms", "is_periodic"), "batch").alias("s")
    return out.groupBy(*fold.EDGE_KEY).agg(newest).select(*fold.EDGE_KEY, "s.*")


add("STR-2", _last_state, PLANT_EDGES.format(where="true"))


def _feed_stream(p: Plant) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events_stream(p.spark, p.sf).select(
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 12).cast("string")).alias("ip"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("protocol"), (k % 10 + 1).cast("bigint").alias("packet_count"), F.col("value").alias("avg_interval_ms"))


WINDOWS = """, feed AS (SELECT '10.0.0.' || (user_id % 12) AS ip, us, event_type AS protocol, k % 10 + 1 AS packet_count, value FROM ev)
  """
add("STR-3", lambda p: rounded(_stream(p, monitor.rolling_baseline(_feed_stream(p), "sliding"), "update").drop("batch"), "mean_interval_ms", "std_interval_ms"),
    WINDOWS + """, w AS (SELECT ip, (us // 300000000 - i) * 300000000 AS s, packet_count, value FROM feed, range(6) r(i)),
    g AS (SELECT ip, s, CAST(sum(packet_count) AS BIGINT) AS total_packets, avg(value) AS m, stddev_samp(value) AS sd FROM w GROUP BY ip, s)
  SELECT ip, s AS window_start, s + 1800000000 AS window_end, total_packets, round(m, 6) AS mean_interval_ms, round(sd, 6) AS std_interval_ms,
    coalesce(m > 0 AND sd / m > 0.2, false) AS anomaly_candidate FROM g""")
add("STR-4", lambda p: rounded(_stream(p, monitor.rolling_baseline(_feed_stream(p), "tumbling"), "append").drop("batch"), "mean_interval_ms"),
    WINDOWS + """, t AS (SELECT ip, us // 300000000 * 300000000 AS window_start, us // 300000000 * 300000000 + 300000000 AS window_end,
      CAST(sum(packet_count) AS BIGINT) AS total_packets, round(avg(value), 6) AS mean_interval_ms, count(DISTINCT protocol) AS protocol_count
      FROM feed GROUP BY ALL)
    SELECT * FROM t WHERE window_end <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM feed)""")
#: Parts in which the events arrive; every 50th is held back to the last.
PARTS, HELD = 3, 50


def _arrivals(p: Plant) -> DataFrame:
    """Feed rows with the part they arrive in: in order of time, but for those held back."""
    events = table(p.spark, p.sf, "events")
    ends = events.agg(F.min(wall_us("ts")).alias("a"), F.max(wall_us("ts")).alias("b")).first()
    k = F.get_json_object("props", "$.k").cast("int")
    part = F.floor((wall_us("ts") - ends.a) * PARTS / (ends.b - ends.a + 1)).cast("int")
    return events.select(
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 12).cast("string")).alias("ip"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("protocol"), (k % 10 + 1).cast("bigint").alias("packet_count"), F.col("value").alias("avg_interval_ms"),
        F.when(F.col("event_id") % HELD == 0, PARTS - 1).otherwise(part).alias("part"))


def _in_parts(p: Plant, start) -> str:
    """Let the parts arrive one after the other; the query goes on from its checkpoint each time.

    ``start`` takes the stream, a folder for results and one for the checkpoint.
    """
    root, rows = tables.shared_dir(p.spark), _arrivals(p)
    schema = rows.drop("part").schema
    for part in range(PARTS):
        rows.where(F.col("part") == part).drop("part").write.parquet(f"{root}/in/{part}")
        stream = p.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        start(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return f"{root}/out"


def _late_windows(p: Plant, kind: str) -> str:
    return _in_parts(p, lambda feed, out, checkpoint: late.start_windows(feed, out, checkpoint, kind, available_now=True))


def _native_windows(p: Plant, kind: str, mode: str) -> DataFrame:
    """Spark's own windows over the same parts; the last state of each window in update mode."""

    def start(feed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        windowed = monitor.rolling_baseline(feed, kind).writeStream.outputMode(mode)
        return windowed.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    rows = p.spark.read.parquet(_in_parts(p, start))
    keys, rest = late.KEY, [c for c in rows.columns if c not in (*late.KEY, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, "s.*")


ARRIVALS = f""", ends AS (SELECT min(us) AS a, max(us) AS b FROM ev),
  arr AS (SELECT '10.0.0.' || (user_id % 12) AS ip, us, event_type AS protocol, k % 10 + 1 AS packet_count, value,
    CASE WHEN event_id % {HELD} = 0 THEN {PARTS - 1} ELSE (us - a) * {PARTS} // (b - a + 1) END AS part FROM ev, ends),
  marks AS (SELECT p, (SELECT max(us) FROM arr WHERE part < p) - 600000000 AS mark FROM range({PARTS}) r(p)),
  wt AS (SELECT arr.*, mark, us // 300000000 * 300000000 AS s, us // 300000000 * 300000000 + 300000000 AS e FROM arr JOIN marks ON p = part),
  wl AS (SELECT arr.*, mark, (us // 300000000 - i) * 300000000 AS s, (us // 300000000 - i) * 300000000 + 1800000000 AS e FROM arr JOIN marks ON p = part, range(6) r(i))
  """
TUMBLED = """SELECT ip, s AS window_start, e AS window_end, CAST(sum(packet_count) AS BIGINT) AS total_packets, round(avg(value), 6) AS mean_interval_ms,
  count(DISTINCT protocol) AS protocol_count FROM wt WHERE {where} GROUP BY ip, s, e"""
SLID = """SELECT ip, s AS window_start, e AS window_end, CAST(sum(packet_count) AS BIGINT) AS total_packets, round(avg(value), 6) AS mean_interval_ms,
  round(stddev_samp(value), 6) AS std_interval_ms, coalesce(avg(value) > 0 AND stddev_samp(value) / avg(value) > 0.2, false) AS anomaly_candidate
  FROM wl WHERE {where} GROUP BY ip, s, e"""
ON_TIME = "mark IS NULL OR e > mark"
add("STR-4-open", lambda p: rounded(late.read_windows(p.spark, _late_windows(p, "tumbling")), "mean_interval_ms"),
    ARRIVALS + TUMBLED.format(where=ON_TIME))
add("STR-4-late", lambda p: late.read_late(p.spark, _late_windows(p, "sliding")).drop("batch"),
    ARRIVALS + "SELECT ip, us AS ts, protocol, packet_count, value AS avg_interval_ms, s AS window_start, e AS window_end, mark AS watermark FROM wl WHERE e <= mark")
add("STR-4-with-late", lambda p: rounded(late.read_windows(p.spark, _late_windows(p, "sliding"), "sliding", with_late=True), "mean_interval_ms", "std_interval_ms"),
    ARRIVALS + SLID.format(where="true"))


def _accounted(p: Plant) -> DataFrame:
    """Rows in windows and in the side table against all rows."""
    out = _late_windows(p, "tumbling")
    none = F.lit(None).cast("bigint")
    counted = late.read_windows(p.spark, out).select(F.col("total_packets").alias("counted"), none.alias("late"))
    missed = late.read_late(p.spark, out).select(none.alias("counted"), F.col("packet_count").alias("late"))
    sums = counted.unionByName(missed).agg(F.sum("counted").alias("counted"), F.sum("late").alias("late"), F.count("late").alias("late_rows"))
    return sums.withColumn("all_packets", F.col("counted") + F.col("late"))


add("STR-4-account", _accounted,
    ARRIVALS + f"""SELECT CAST(sum(packet_count) FILTER ({ON_TIME}) AS BIGINT) AS counted, CAST(sum(packet_count) FILTER (e <= mark) AS BIGINT) AS late,
      count(*) FILTER (e <= mark) AS late_rows, CAST(sum(packet_count) AS BIGINT) AS all_packets FROM wt""")
# Spark's watermark is in whole milliseconds.
WHOLE_MS = ARRIVALS.replace("- 600000000 AS mark", "// 1000 * 1000 - 600000000 AS mark")
add("STR-3-parts", lambda p: rounded(_native_windows(p, "sliding", "update"), "mean_interval_ms", "std_interval_ms"),
    WHOLE_MS + SLID.format(where=ON_TIME))
NEW_KEYS = PLANT_EDGES.format(where="true").replace("SELECT *, CASE", ", f AS (SELECT *, CASE") + ") "


def _alerts(p: Plant, alerts: DataFrame, keys: list[str]) -> DataFrame:
    """What is new by the last state of each key."""
    last = _stream(p, alerts, "update").groupBy(*keys).agg(F.max_by(F.struct("seen_at", "is_new"), "batch").alias("s"))
    return last.where("s.is_new").select(*keys, "s.seen_at")


add("STR-5", lambda p: _alerts(p, monitor.new_edge_alerts(_comm_stream(p), at(EARLY_END_US)), fold.EDGE_KEY),
    NEW_KEYS + f"SELECT {EDGE}, first_seen AS seen_at FROM f WHERE first_seen > {EARLY_END_US}")
add("STR-5-devices", lambda p: _alerts(p, monitor.new_device_alerts(_comm_stream(p), at(EARLY_END_US)), ["ip"]),
    f"""SELECT ip, min(ts_us) AS seen_at FROM (SELECT orig_h AS ip, ts_us FROM plant UNION ALL SELECT resp_h, ts_us FROM plant)
    GROUP BY ip HAVING min(ts_us) > {EARLY_END_US}""")


def _silence(p: Plant) -> DataFrame:
    """Senders on the plain clock that were quiet for their threshold."""
    k = F.get_json_object("props", "$.k").cast("int")
    comm = events_stream(p.spark, p.sf).select(
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("orig_h"), F.col("ts").cast("timestamp").alias("ts")
    ).withWatermark("ts", "10 minutes")
    return _stream(p, monitor.silence_alerts(comm), "append").select("ip", "last_seen", "silent_at", "threshold_s", "packets")


add("STR-6", _silence,
    """, s AS (SELECT '10.0.0.' || user_id AS ip, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 600000000 THEN 0 ELSE 1 END AS fresh FROM ev),
    g AS (SELECT ip, us, sum(fresh) OVER (PARTITION BY ip ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM s),
    w AS (SELECT ip, max(us) AS last_seen, max(us) + 600000000 AS silent_at, CAST(600 AS DOUBLE) AS threshold_s, count(*) AS packets FROM g GROUP BY ip, n)
    SELECT * FROM w WHERE silent_at <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM ev)""")
#: How long after the last event the clock of the silence check stands.
CLOCK_AFTER_US = 1_200_000_000


def _clock_silence(p: Plant) -> DataFrame:
    """Last alerts of senders while the clock stands some minutes after the last of three batches."""
    raw = events_stream(p.spark, p.sf, 3).select(
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("orig_h"), F.col("ts").cast("timestamp").alias("ts"))
    newest = table(p.spark, p.sf, "events").agg(F.max(wall_us("ts")).alias("us")).first().us
    roles = p.spark.range(8).selectExpr("concat('10.0.0.', id * 3 + 1) AS ip", "element_at(array('plc', 'hmi', 'Engineering', 'other'), CAST(id % 4 + 1 AS INT)) AS role")
    alerts = silence.clock_silence_alerts(raw, roles, clock=silence.Clock(newest + CLOCK_AFTER_US, speed=0))
    rows = _stream(p, alerts, "update", batches=6)
    last = rows.groupBy("ip").agg(F.max_by(F.struct("role", "last_seen", "silent_for_s", "threshold_s", "severity"), F.struct("last_seen", "batch")).alias("a"))
    return last.where("a.severity IS NOT NULL").select("ip", "a.*")


add("STR-6-clock", _clock_silence,
    f""", s AS (SELECT '10.0.0.' || user_id AS ip, user_id, max(us) AS last_seen, (SELECT max(us) + {CLOCK_AFTER_US} FROM ev) AS now FROM ev GROUP BY user_id),
    r AS (SELECT *, CASE WHEN user_id % 3 = 1 AND user_id <= 22 THEN ['plc', 'hmi', 'Engineering', 'other'][((user_id - 1) // 3) % 4 + 1] END AS role FROM s),
    t AS (SELECT ip, role, last_seen, (now - last_seen) / 1e6 AS silent_for_s, CAST(CASE lower(role) WHEN 'plc' THEN 300 WHEN 'hmi' THEN 900 WHEN 'engineering' THEN 3600 ELSE 600 END AS DOUBLE) AS threshold_s FROM r)
    SELECT *, CASE WHEN silent_for_s >= 6 * threshold_s THEN 'high' WHEN silent_for_s >= 2 * threshold_s THEN 'medium' ELSE 'low' END AS severity
    FROM t WHERE silent_for_s >= threshold_s""")
add("STR-7", lambda p: p.spark.read.parquet(f"{_consumed(p)}/counts").agg(
        F.sum("consumed").alias("consumed"), F.sum("ingested").alias("ingested"), F.sum("errors").alias("errors")),
    f"SELECT count(*) AS consumed, count(*) FILTER ({GOOD}) AS ingested, count(*) FILTER (NOT ({GOOD})) AS errors FROM plant")

import json
import time
from datetime import datetime, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.conftest import EDGE_DDL, T0, at, rows
from wirebook.operators import fold
from wirebook.plans import pipeline
from wirebook.sources import messages, tables
from wirebook.sources.events import normalize, of_type
from wirebook.operators.coverage import silent_devices
from wirebook.operators.windows import sliding_window, tumbling_window
from wirebook.streaming import consume, late, monitor, silence

ENDS = {"uid": "Cabc", "orig_h": "10.0.0.57", "orig_p": 2578, "resp_h": "10.0.0.3", "resp_p": 502}
MODBUS = {"ts": "2004-08-26T12:00:00+00:00", **ENDS, "func": "READ_COILS", "exception": None}
CONN = {"ts": "2004-08-26T12:00:00", **ENDS, "proto": "tcp", "conn_state": "SF", "duration": 0.5, "local_orig": True, "tunnel_parents": ["u"]}


def decode(spark, *pairs, prefix=""):
    sent = [(t, bytearray(v if isinstance(v, bytes) else json.dumps(v).encode())) for t, v in pairs]
    return messages.decode_messages(spark.createDataFrame(sent, "topic string, value binary"), prefix)


def test_decoding_good_and_bad(spark):
    without = {k: v for k, v in MODBUS.items() if k != "uid"}
    got = decode(
        spark, ("raw.modbus", MODBUS), ("raw.conn", CONN), ("raw.modbus", {**MODBUS, "resp_p": "503", "uid": None}),
        ("raw.modbus", without), ("raw.modbus", {**MODBUS, "orig_p": "x"}), ("raw.modbus", {**MODBUS, "ts": "soon"}),
        ("raw.http", MODBUS), ("raw.modbus", b"{not json"), ("raw.modbus", b"\xff\xfe"), ("raw.modbus", b"[1]"),
    )
    assert rows(got.groupBy("reason").count()) == [
        ("bad_encoding", 1), ("bad_json", 2), ("bad_value", 2), ("missing_field", 1), ("unknown_topic", 1), (None, 3)]
    c = of_type(messages.good(got), "conn").first()
    assert (c.duration, c.local_orig, c.tunnel_parents, c.service, c.orig_pkts) == (0.5, True, ["u"], None, None)
    assert c.ts.timestamp() == datetime(2004, 8, 26, 12, tzinfo=timezone.utc).timestamp()
    assert rows(of_type(messages.good(got), "modbus").select("resp_p", "uid")) == [(502, "Cabc"), (503, None)]


def test_messages_round_trip(spark, tmp_path):
    events = messages.good(decode(spark, ("site.raw.modbus", MODBUS), ("site.raw.conn", CONN), prefix="site."))
    sent = messages.to_messages(events, "site.")
    assert rows(sent.select("topic", "key")) == [("site.raw.conn", "10.0.0.57:10.0.0.3"), ("site.raw.modbus", "10.0.0.57:10.0.0.3")]
    value = json.loads(sent.where("topic = 'site.raw.modbus'").first().value)
    assert value == MODBUS
    messages.write_messages(sent, str(tmp_path / "m"))
    back = messages.good(messages.decode_messages(spark.read.parquet(str(tmp_path / "m")), "site."))
    assert rows(back.drop("key").select(*events.columns)) == rows(events)


def test_kafka_options():
    assert messages.kafka_options("h:1", "dev.") == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "dev.raw.modbus,dev.raw.dnp3,dev.raw.conn", "startingOffsets": "earliest", "failOnDataLoss": "false"}


def sent_batches(spark, path, batches):
    for batch in batches:
        values = [("raw.modbus", "k", json.dumps({**MODBUS, "ts": at(t).isoformat(), "uid": f"C{t}", "orig_h": ip})) for t, ip in batch]
        spark.createDataFrame(values, "topic string, key string, value string").coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path):
    return spark.readStream.schema("topic string, key string, value string").option("maxFilesPerTrigger", 1).parquet(str(path))


BATCHES = [[(0, "a"), (1, "b"), (2, "a")], [(3, "a"), (700, "c")], [(701, "a"), (4, "b"), (2000, "c")]]


def batch_comm(spark, path):
    return normalize(messages.good(messages.decode_messages(spark.read.parquet(str(path)))))


def test_consumer_equals_batch_and_survives_replay(spark, tmp_path):
    sent_batches(spark, tmp_path / "in", BATCHES)
    root = str(tmp_path / "out")
    for _ in range(2):  # the second run resumes and finds nothing new
        consume.start_consumer(stream(spark, tmp_path / "in"), root, root + "/cp", available_now=True).awaitTermination()
    want = rows(fold.fold_edges(batch_comm(spark, tmp_path / "in")))
    assert rows(tables.read_edges(spark, root + "/edges")) == want
    counts = spark.read.parquet(root + "/counts")
    assert counts.count() == 3 and counts.agg(F.sum("ingested")).first()[0] == 8
    assert tables.compact(spark, root + "/edges") == 2 and rows(tables.read_edges(spark, root + "/edges")) == want
    # Delivering a batch again replaces it.
    extra = spark.createDataFrame([("raw.modbus", json.dumps({**MODBUS, "ts": at(9000).isoformat(), "orig_h": "a"}))], "topic string, value string")
    for _ in range(2):
        consume.ingest_batch(extra, 100, root)
    a = tables.read_edges(spark, root + "/edges").where("src_ip = 'a'").first()
    assert a.packet_count == 5


def collect_stream(spark, df, tmp_path, mode):
    out = str(tmp_path / "collected")
    df.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option(
        "checkpointLocation", out + "_cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_running_edges_end_as_the_batch_fold(spark, tmp_path):
    sent_batches(spark, tmp_path / "in", BATCHES)
    out = collect_stream(spark, monitor.running_edges(consume.stream_communications(stream(spark, tmp_path / "in"), delay="1 day")), tmp_path, "update")
    last = out.groupBy("src_ip").agg(F.max_by("packet_count", "batch").alias("n"))
    assert rows(last) == [("a", 4), ("b", 2), ("c", 2)]


def test_duplicates_agree_in_every_field(spark, tmp_path):
    other = {**MODBUS, "exception": "ILLEGAL_FUNCTION"}
    for n, events in enumerate([[MODBUS, MODBUS, other], [other]]):
        sent = [("raw.modbus", bytearray(json.dumps(e).encode())) for e in events]
        spark.createDataFrame(sent, "topic string, value binary").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema("topic string, value binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    assert collect_stream(spark, consume.stream_communications(source, dedupe=True), tmp_path, "append").count() == 2


def test_alerts_come_once(spark, tmp_path):
    sent_batches(spark, tmp_path / "in", BATCHES)
    comm = consume.stream_communications(stream(spark, tmp_path / "in"), delay="1 day")
    known = fold.fold_edges(batch_comm(spark, tmp_path / "in").where("orig_h = 'a'"))
    edges = collect_stream(spark, monitor.new_edge_alerts(comm, at(1), known), tmp_path / "e", "update")
    assert rows(edges.select("src_ip").distinct()) == [("b",), ("c",)]
    devices = collect_stream(spark, monitor.new_device_alerts(comm, at(600), known.select(F.col("src_ip").alias("ip"))), tmp_path / "d", "update")
    assert rows(devices.select("ip").distinct()) == [("10.0.0.3",), ("c",)]
    # Without a list, what was seen before the cutoff is not new, though it comes back after it.
    fresh = collect_stream(spark, monitor.new_device_alerts(comm, at(600)), tmp_path / "f", "update")
    last = fresh.groupBy("ip").agg(F.max_by("is_new", "batch").alias("new"))
    assert rows(last.where("new").select("ip")) == [("c",)] and last.count() == 4


def test_silence_closes_by_role(spark, tmp_path):
    sent_batches(spark, tmp_path / "in", [*BATCHES, [(5000, "z")], [(5001, "z")]])
    comm = consume.stream_communications(stream(spark, tmp_path / "in"), delay="1 minute")
    roles = spark.createDataFrame([("a", "plc"), ("c", "engineering")], "ip string, role string")
    got = collect_stream(spark, monitor.silence_alerts(comm, roles), tmp_path, "append")
    # a is quiet after 3 s and again after 701 s; c may rest for an hour.
    assert [(r.ip, r.threshold_s) for r in got.orderBy("ip", "last_seen").collect()] == [("a", 300.0), ("a", 300.0), ("b", 600.0)]


def test_rolling_baseline_to_files(spark, tmp_path):
    values = [(json.dumps({"ip": "a", "ts": 1704067200 + 60 * i, "protocol": "modbus", "packet_count": 2, "avg_interval_ms": 100.0 + i}),) for i in range(120)]
    spark.createDataFrame(values, "value string").write.parquet(str(tmp_path / "in"))
    feed = monitor.parse_feed(spark.readStream.schema("value string").parquet(str(tmp_path / "in")))
    monitor.start_baseline(monitor.rolling_baseline(feed, "tumbling"), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() > 10 and {r.total_packets for r in got.collect()} == {10}


@pytest.mark.parametrize("name", ["DET-1", "ROLE-2", "BASE-1", "COV-1", "ATK-6", "PID-2", "SRC-10", "STR-6"])
def test_registered_queries_agree_with_sql(spark, name):
    import __spark_entry__ as entry
    from checks.compare import compare, duck

    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), entry.queries()[name], sf, entry.oracle_sql()[name]).startswith("same")


def test_pipeline_from_logs(spark, tmp_path):
    from tests.test_zeek import MODBUS as FIELDS
    from tests.test_zeek import log, modbus, write

    write(tmp_path / "logs", "modbus.log", log("modbus", FIELDS, [modbus(str(1704067200 + i), f"C{i}") for i in range(5)]))
    out = pipeline.run(spark, str(tmp_path / "logs"), str(tmp_path / "out"), at(-1), at(3600))
    counts = {r.category: r["count"] for r in out["findings"].groupBy("category").count().collect()}
    assert counts == {"new_devices": 2, "new_edges": 1}
    graph = pipeline.load_graph(spark, str(tmp_path / "out"))
    # Codes that no rule names still give the general modbus rule.
    assert rows(graph.devices.select("ip", "role", "inferred_purdue_level")) == [("10.0.0.3", "unknown", 3), ("10.0.0.57", "plc", 1)]
    assert out["silence"].first().severity == "high" and out["stats"].first().edge_count == 1
    tactic = {r.tactic for r in pipeline.attack_map(graph, at(-1))[1].collect()}
    assert "Discovery" in tactic


def sightings(spark, path, *batches):
    """A stream of (seconds, sender) in the given batches."""
    for k, batch in enumerate(batches):
        made = [(ip, None if t is None else at(t)) for t, ip in batch]
        spark.createDataFrame(made, "orig_h string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema("orig_h string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def alerts_of(alerts, tmp_path, done, seconds=60):
    """Run alerts until ``done`` of the rows (batch, alert ...), in order."""
    found = []

    def keep(batch, batch_id):
        found.extend((batch_id, *r) for r in batch.collect())

    query = alerts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        stop = time.time() + seconds
        while time.time() < stop and query.isActive and not done(found, query):
            time.sleep(0.1)
    finally:
        query.stop()
    assert query.exception() is None
    return sorted(found)


def test_clock_silence_equals_the_batch_query(spark, tmp_path):
    """After several batches the last alerts are those of the batch query at the moment the clock shows."""
    first = [(0, "a"), (10, "b"), (5, "c"), (0, "d"), (None, "e"), (1, None)]
    second = [(2000, "a"), (1500, "b"), (3, "c"), *[(k % 900, "d") for k in range(3000)]]
    third = [(3500, "b"), (2500, "a"), (3100, "f")]
    roles = spark.createDataFrame([("a", "PLC"), ("c", "engineering"), ("d", "hmi"), ("x", "plc")], "ip string, role string")
    now = 3900
    clock = silence.Clock(int(at(now).timestamp() * 1e6), speed=0)
    stream = sightings(spark, tmp_path / "in", first, second, third)
    got = alerts_of(silence.clock_silence_alerts(stream, roles, clock=clock), tmp_path, lambda _, q: (q.lastProgress or {"batchId": 0})["batchId"] >= 6)
    last = {r[1]: (r[2], r[3], r[5], r[6], r[7]) for r in got}
    comm = [(t, ip) for batch in (first, second, third) for t, ip in batch if t is not None and ip is not None]
    seen = {}
    for t, ip in comm:
        seen[ip] = max(t, seen.get(ip, t))
    devices = spark.createDataFrame([(ip, at(t)) for ip, t in seen.items()], "ip string, last_seen timestamp").join(roles, "ip", "left")
    edges = spark.createDataFrame([(ip,) for ip in seen], "src_ip string")
    batch = silent_devices(edges, devices, at(now)).collect()
    assert len(batch) > 2
    assert {ip: a for ip, a in last.items() if a[-1]} == {r.ip: (r.role, r.last_seen, r.silent_for_s, r.threshold_s, r.severity) for r in batch}


def test_silence_alerts_without_events_and_ends_with_one(spark, tmp_path):
    """On a live clock severity rises though nothing comes; the next event ends the alert."""
    now = time.time()
    path = tmp_path / "in"
    stream = sightings(spark, path, [(now - T0.timestamp(), "a")])
    sent = []

    def done(found, query):
        levels = [r[-1] for r in found]
        if levels[-1:] == ["high"] and not sent:
            sent.append(time.time() + 60 - T0.timestamp())
            sightings(spark, path / "later", [(sent[0], "a")])
        return None in levels

    alerts = silence.clock_silence_alerts(stream, default_seconds=2.0)
    got = alerts_of(alerts, tmp_path, done, 90)
    assert [r[-1] for r in got] in (["low", "medium", "high", None], ["medium", "high", None], ["low", "high", None], ["high", None])
    for r in got[:-1]:
        assert r[5] >= {"low": 2, "medium": 4, "high": 12}[r[-1]]
    assert abs(got[-1][3].timestamp() - at(sent[0]).timestamp()) < 1e-3


FEED = "ip string, ts timestamp, protocol string, packet_count long, avg_interval_ms double"


@pytest.mark.parametrize("kind", ["tumbling", "sliding"])
def test_late_rows_are_kept_apart_and_replays_count_once(spark, tmp_path, kind):
    def feed(*made):
        return spark.createDataFrame([(ip, None if t is None else at(t), p, n, x) for ip, t, p, n, x in made], FEED)

    root = str(tmp_path)
    first = [("a", 10, "modbus", 1, 5.0), ("a", 20, "dnp3", 2, 7.0), ("b", 1500, "modbus", 4, None), (None, 30, None, None, 1.0)]
    second = [("a", 250, "modbus", 8, 1.0), ("b", 1000, "x", 16, 2.0), ("a", 4000, "x", 32, 3.0), ("a", None, "x", 64, 4.0)]
    third = [("a", 260, "modbus", 128, 9.0), ("b", 3999, "y", 256, 1.5)]
    batches = [first, second, third]
    for k, batch in enumerate(batches):
        late.window_batch(feed(*batch), k, root, kind, 600)
        late.window_batch(feed(*batch), k, root, kind, 600)
    length, slide = (300, 300) if kind == "tumbling" else (1800, 300)
    windows = lambda t: [s for s in range(t // slide * slide - length + slide, t + 1, slide)]
    on_time, missed, mark = [], [], None
    for batch in batches:
        for row in batch:
            if row[1] is None:
                missed.append((row, None))
                continue
            for s in windows(row[1]):
                (on_time if mark is None or s + length > mark else missed).append((row, s))
        mark = max([r[1] for r in batch if r[1] is not None] + ([] if mark is None else [mark + 600])) - 600
    sides = late.read_late(spark, root)
    seconds = lambda c: F.unix_seconds(c) - int(at(0).timestamp())
    got = sides.select("ip", seconds(F.col("ts")).alias("t"), "protocol", "packet_count", "avg_interval_ms", seconds(F.col("window_start")).alias("s"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*r, s) for r, s in missed), key=repr)
    assert sides.where("batch = 2").count() > 0
    sums = {}
    for row, s in on_time:
        sums.setdefault((row[0], s), []).append(row)
    found = {(r.ip, r.s): r for r in late.read_windows(spark, root, kind).withColumn("s", seconds(F.col("window_start"))).collect()}
    assert set(found) == set(sums)
    for key, members in sums.items():
        packets = [r[3] for r in members if r[3] is not None]
        assert found[key].total_packets == (sum(packets) if packets else None)
    # With the late rows all is as if no row had been late.
    whole = late.read_windows(spark, root, kind, with_late=True)
    plain = (tumbling_window if kind == "tumbling" else sliding_window)(feed(*first, *second, *third).where("ts IS NOT NULL"))
    near = [F.round(c, 9).alias(c) if c.endswith("_ms") else F.col(c) for c in plain.columns]
    assert rows(whole.select(*plain.columns).select(*near)) == rows(plain.select(*near))


def delta(spark, *made):
    full = [(ip, "b", "m", 1, "f", at(t), at(t), n, 0.0, False) for ip, t, n in made]
    return spark.createDataFrame(full, EDGE_DDL)


def totals(df):
    return {r.src_ip: r.packet_count for r in df.collect()}


def test_a_reader_sees_one_state_while_tables_are_compacted(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for k in range(3):
        tables.write_delta(delta(spark, ("a", k, 1), (f"n{k}", k, 5)), root, k)
    state = {"a": 3, "n0": 5, "n1": 5, "n2": 5}
    before = tables.read_edges(spark, root)
    between = []

    def publish(folder, number, real=tables.publish):
        # The new base is whole but not current yet.
        between.append(totals(tables.read_edges(spark, root)))
        found = real(folder, number)
        between.append(totals(tables.read_edges(spark, root)))
        return found

    monkeypatch.setattr(tables, "publish", publish)
    assert tables.compact(spark, root) == 2
    assert between == [state, state] and totals(before) == state
    monkeypatch.undo()
    # A batch that is replayed after it was merged, and one that is not whole yet, do not count.
    tables.write_delta(delta(spark, ("a", 2, 1), ("n2", 2, 5)), root, 2)
    tables.write_delta(delta(spark, ("a", 9, 100)), root, 3)
    tables.Folder(spark, root).remove("kind=delta/batch=3/_SUCCESS")
    assert totals(tables.read_edges(spark, root)) == state
    assert tables.compact(spark, root) == 2


def test_folders_stay_bounded(spark, tmp_path):
    root, folder = str(tmp_path), tables.Folder(spark, str(tmp_path))
    assert totals(tables.read_edges(spark, root)) == {} and tables.compact(spark, root) == -1
    for k in range(8):
        tables.write_delta(delta(spark, ("a", k, 1)), root, k)
        if k % 2:
            tables.compact(spark, root)
    assert totals(tables.read_edges(spark, root)) == {"a": 8}
    assert folder.numbers("kind=base", "batch=") == [5, 7] and folder.numbers("kind=delta", "batch=") == [6, 7]
    assert folder.numbers(tables.POINTER, "") == [5, 7]


def test_a_folder_of_one_machine_is_refused_on_a_cluster(monkeypatch):
    monkeypatch.setattr(tables.atexit, "register", lambda *_: None)

    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    def session(master, **conf):
        return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))

    for warehouse in ("file:/tmp/warehouse", "/tmp/warehouse", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(session("spark://host:7077", **{"spark.sql.warehouse.dir": warehouse}))
    assert tables.shared_dir(session("yarn", **{"spark.sql.warehouse.dir": "hdfs://n/w"})).startswith("hdfs://n/w/")
    assert tables.shared_dir(session("yarn", **{"spark.checkpoint.dir": "/shared"})).startswith("/shared/")
    assert tables.shared_dir(session("local[2]", **{"spark.sql.warehouse.dir": "file:/w"})).startswith("file:/w/")


def test_a_batch_of_the_stream_has_more_files_where_there_are_more_events(spark, tmp_path, monkeypatch):
    from checks import tables as checked

    monkeypatch.setattr(checked, "FILE_ROWS", 25)
    spark.range(300).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    seen = {}

    def count(batch, number):
        seen[number] = (batch.count(), batch.select("file").distinct().count())

    stream = checked.events_stream(spark, str(tmp_path), 3).withColumn("file", F.input_file_name())
    stream.writeStream.foreachBatch(count).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sum(rows for rows, _ in seen.values()) == 300
    assert [files for _, files in seen.values()] == [4, 4, 4]


def test_messages_are_put_in_order_by_as_many_tasks_as_their_number_asks_for(spark, monkeypatch):
    monkeypatch.setattr(messages, "TASK_ROWS", 10)
    sent = spark.range(100).select(F.lit("raw.conn").alias("topic"), F.lit("a:b").alias("key"), F.lit("{}").alias("value"), F.col("id").alias("seq"))
    parts = messages._in_order(sent).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 10 and sum(r["count"] for r in parts) == 100

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wirebook.operators import detect, fold
from wirebook.sources.events import normalize, of_type
from wirebook.sources.zeek import read_zeek

# A tree of real ICS logs (public ICS-pcap collection); the tests on it are skipped without one.
CORPUS = os.environ.get("ZEEK_CORPUS", "")
MODBUS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "func", "exception"]
DNP3 = MODBUS[:6] + ["fc_request", "fc_reply", "iin"]
CONN = MODBUS[:6] + [
    "proto", "service", "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp", "missed_bytes",
    "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "tunnel_parents",
]
CONN_ROW = ["1704067200.5", "C9", "10.0.0.1", "55000", "10.0.0.2", "502", "tcp", "modbus", "0.5", "100", "200", "SF", "T", "F", "0",
            "ShAD", "4", "240", "3", "180", "(empty)"]


def log(path, fields, lines, end="#close\t2024", sep="\t", newline="\n"):
    head = ["#separator \\x09", f"#set_separator{sep},", f"#empty_field{sep}(empty)", f"#unset_field{sep}-", f"#path{sep}{path}",
            sep.join(["#fields", *fields]), sep.join(["#types", *["string"] * len(fields)])]
    return newline.join([*head, *[sep.join(r) for r in lines], end, ""])


def modbus(ts, uid, func="READ_COILS", exception="-", port="502"):
    return [ts, uid, "10.0.0.57", "2578", "10.0.0.3", port, func, exception]


def write(directory, name, text):
    directory.mkdir(parents=True, exist_ok=True)
    (directory / name).write_text(text)


def test_records_of_each_kind(spark, tmp_path):
    write(tmp_path / "a", "modbus.log", log("modbus", MODBUS, [modbus("1093521704.839184", "C1"), modbus("1704067201.0", "C2", exception="ILLEGAL_FUNCTION")]))
    write(tmp_path / "a", "dnp3.log", log("dnp3", DNP3, [[*modbus("1704067202", "C3")[:6], "-", "-", "-"], [*modbus("1704067203", "C4")[:6], "READ", "RESPONSE", "36866"]]))
    write(tmp_path / "b", "conn.log", log("conn", CONN, [CONN_ROW, [*CONN_ROW[:7], "-", "-", "-", "-", "SF", "-", "t", *CONN_ROW[14:20], "u1,u2"]]))
    events = read_zeek(spark, str(tmp_path)).events
    m = of_type(events, "modbus").orderBy("uid").collect()
    assert m[0].ts.timestamp() == 1093521704.839184 and m[0].exception is None and m[0].resp_p == 502
    assert m[1].exception == "ILLEGAL_FUNCTION"
    d = of_type(events, "dnp3").orderBy("uid").collect()
    assert (d[0].fc_request, d[0].fc_reply, d[0].iin) == ("-", None, None)
    assert (d[1].fc_reply, d[1].iin) == ("RESPONSE", 36866)
    c = of_type(events, "conn").orderBy("service").collect()
    assert (c[0].service, c[0].duration, c[0].local_orig, c[0].local_resp, c[0].tunnel_parents) == (None, None, None, False, ["u1", "u2"])
    assert (c[1].service, c[1].duration, c[1].local_orig, c[1].local_resp, c[1].tunnel_parents) == ("modbus", 0.5, True, False, [])


def test_faulty_lines_and_files(spark, tmp_path):
    lines = [["1", "2", "3", "4", "5"], modbus("1704067200", "Cdef"), modbus("n/a", "Cbad"), modbus("1704067200", "Cport", port="1.5"), ["# a remark"]]
    text = log("modbus", MODBUS, lines) + "\t".join(modbus("1704067209", "Cxxx")) + "\n"
    write(tmp_path, "modbus.log", text)
    write(tmp_path / "empty", "modbus.log", "")
    write(tmp_path / "nofields", "conn.log", "version https://example.org/spec\noid 1\n")
    write(tmp_path / "http", "conn.log", log("http", MODBUS, [modbus("1704067200", "Chttp")]))
    write(tmp_path / "short", "dnp3.log", log("dnp3", DNP3[:-1], [[*modbus("1704067200", "Cmiss")[:6], "READ", "-"]]))
    write(tmp_path / "headonly", "dnp3.log", log("dnp3", DNP3, [], end="#close"))
    write(tmp_path, "other.log", log("modbus", MODBUS, [modbus("1704067200", "Cother")]))
    logs = read_zeek(spark, str(tmp_path))
    assert [r.uid for r in logs.events.collect()] == ["Cdef"]
    assert rows(logs.rejected.select("reason")) == [("bad_value",), ("bad_value",), ("field_count",), ("missing_field",)]


def test_long_file_is_split_and_keeps_its_end(spark, tmp_path):
    """A log read in many blocks agrees with the same log read as a whole."""
    lines = [modbus(f"{1704067200 + i}.{i % 1000000:06d}", f"C{i}", func="READ_COILS" if i % 3 else "DIAGNOSTICS") for i in range(30000)]
    lines.insert(21000, ["#close"])
    write(tmp_path, "modbus.log", log("modbus", MODBUS, lines))
    size = os.path.getsize(tmp_path / "modbus.log")
    def edges():
        logs = read_zeek(spark, str(tmp_path))
        assert logs.events.count() == 21000
        return rows(fold.fold_edges(normalize(logs.events), fold.ARRIVAL).drop("first_seq"))

    whole = edges()
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 9))
    spark.conf.set("spark.sql.files.openCostInBytes", str(size // 9))
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert edges() == whole
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_other_separator_and_line_ends(spark, tmp_path):
    text = log("modbus", MODBUS, [modbus("1704067200", "C1")], sep="|", newline="\r\n").replace("\\x09", "\\x7c")
    write(tmp_path, "modbus.log", text)
    assert [r.uid for r in read_zeek(spark, str(tmp_path)).events.collect()] == ["C1"]


def test_missing_directory_is_empty(spark):
    assert read_zeek(spark, "/nonexistent/logs").events.count() == 0


@pytest.mark.skipif(not os.path.isdir(CORPUS), reason="log corpus not present")
def test_bundled_corpus(spark):
    logs = read_zeek(spark, CORPUS)
    events = logs.events.persist()
    assert {r.log: r["count"] for r in events.groupBy("log").count().collect()} == {"modbus": 365, "dnp3": 337, "conn": 907}
    assert logs.rejected.count() == 0
    comm = normalize(events)
    for mode, periodic, deviating in ((fold.EVENT_TIME, 15, 234), (fold.ARRIVAL, 12, 237)):
        edges = fold.fold_edges(comm, mode).persist()
        assert (edges.count(), edges.where("packet_count > 1").count()) == (559, 249)
        assert fold.fold_devices(edges, mode=mode).count() == 459
        assert (edges.where("is_periodic").count(), detect.interval_deviation(edges).count()) == (periodic, deviating)
        assert detect.unknown_protocol(edges).count() == 165
        edges.unpersist()
    events.unpersist()


@pytest.mark.skipif(not os.path.isdir(CORPUS), reason="log corpus not present")
def test_one_channel_of_the_corpus(spark):
    edges = fold.fold_edges(normalize(read_zeek(spark, CORPUS + "/MODBUS/Modbus").events))
    poll = edges.where("protocol = 'modbus'").first()
    assert (poll.packet_count, poll.is_periodic, poll.function_code) == (51, True, "READ_HOLDING_REGISTERS")
    assert abs(poll.avg_interval_ms - 462.16258) < 1e-6
    assert edges.where(F.col("protocol") == "tcp").first().packet_count == 1

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import model_queries, registry  # noqa: F401
from tests.conftest import T0, at, rows
from wirebook import catalog
from wirebook.functions import stats
from wirebook.operators import attack, baseline, conduits, coverage, detect, extensions, fold, policy, procid, roles, views, zones
from wirebook.sources import tables


def comm(spark, events):
    return spark.createDataFrame(
        [(at(t), a, b, "modbus", 502, "READ", i) for i, (t, a, b) in enumerate(events)],
        "ts timestamp, orig_h string, resp_h string, protocol string, port int, function_code string, ingest_seq bigint",
    )


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from("ab"), st.sampled_from("bc")), min_size=1, max_size=30), st.integers(1, 5))
def test_fold_ignores_order_and_partitioning(spark, events, parts):
    one = rows(fold.fold_edges(comm(spark, events)))
    shuffled = events[:]
    random.Random(parts).shuffle(shuffled)
    assert rows(fold.fold_edges(comm(spark, shuffled).repartition(parts))) == one
    half = len(events) // 2
    merged = fold.merge_edges(*[fold.fold_edges(comm(spark, p)) for p in (events[:half], events[half:]) if p])
    assert rows(merged) == one


def test_arrival_order_decides_first_seen(spark):
    late_first = comm(spark, [(5, "a", "b"), (1, "a", "b"), (9, "a", "a")])
    edges = fold.fold_edges(late_first, fold.ARRIVAL)
    assert rows(edges.where("dst_ip = 'b'").select("first_seen", "last_seen", "packet_count")) == [(naive(5), naive(5), 2)]
    assert rows(fold.fold_edges(late_first).where("dst_ip = 'b'").select("first_seen")) == [(naive(1),)]
    assert rows(fold.fold_devices(edges, mode=fold.ARRIVAL).select("ip", "first_seen", "last_seen")) == [
        ("a", naive(5), naive(9)), ("b", naive(5), naive(5))]


def naive(seconds):
    # Spark hands timestamps over in local time without a zone.
    from datetime import datetime

    return datetime.fromtimestamp(at(seconds).timestamp())


def test_detections_on_boundaries(spark, edges):
    e = edges(("a", "b", "modbus", 502, "READ", 0, 1, 11, 100.0), ("a", "b", "dnp3", 20000, "READ", 0, 1, 2, 1000.0),
              ("a", "c", "http", 80, "flow", 5, 5, 1, 0.0), ("b", "c", "Modbus", 502, "READ", 6, 9, 2, 1000.1), ("c", "c", None, 1, "x", 7, 8, 3, 99.9))
    assert rows(detect.interval_deviation(e).select("src_ip", "avg_interval_ms")) == [("b", 1000.1), ("c", 99.9)]
    assert rows(detect.new_edges(e, at(5)).select("src_ip")) == [("b",), ("c",)]
    assert rows(detect.unknown_protocol(e).select("protocol")) == [("Modbus",), ("http",)]
    assert detect.unknown_protocol(e, []).count() == 5
    assert policy.unknown_protocol(e).count() == 3
    assert rows(policy.interval_deviation(e, 600.0, 300.0).where("src_ip = 'a'").select("reason")) == [("above_maximum",), ("below_minimum",)]
    assert [r.avg_interval_ms for r in detect.interval_deviation(e).collect()] == [99.9, 1000.1]
    assert detect.parse_allowlist(" modbus, ,dnp3,") == ["modbus", "dnp3"]


def test_cross_zone_multiplies_by_membership(spark, edges):
    e = edges(("a", "b", "modbus", 502, "READ", 0, 0, 1), ("a", "c", "modbus", 502, "READ", 0, 0, 1))
    member = spark.createDataFrame([("a", "Field"), ("a", "Business"), ("b", "Operations")], "ip string, zone_name string")
    found = detect.cross_zone_violations(e, member, catalog.zones_frame(spark))
    assert rows(found.select("src_zone", "dst_zone")) == [("Field", "Operations")]


def shuffled_rows(df):
    """Rows that the shuffles of a collected frame wrote, those of its subqueries apart."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_policies_shuffle_rows_only_where_keys_repeat(spark, edges, tmp_path):
    each = [("a", "b", "telnet", 23, "x", 5, 9, 2), ("a", None, "telnet", 23, "x", 6, 9, 2), (None, "a", "telnet", 23, "x", 6, 9, 2),
            ("b", "c", None, 502, "READ", 7, 7, 1), ("b", "c", "READ", 502, None, 7, 7, 1), ("c", "c", "modbus", 502, "READ", 0, 90, 4)]
    none = spark.createDataFrame([], "ip string, zone_name string")

    def found(name, *lines):
        edges(*lines).write.parquet(str(tmp_path / name))
        e = spark.read.parquet(str(tmp_path / name))
        told = policy.run_policies(e, fold.fold_devices(e), none, catalog.zones_frame(spark), at(1), min_ms=5000.0, max_ms=100.0)
        kinds = ("new_edges", "unknown_protocol", "interval_deviation")
        return {k: rows(told[k]) for k in kinds}, {k: shuffled_rows(told[k]) for k in kinds if told[k].collect()}

    once, moved = found("once", *each)
    assert {k: len(v) for k, v in once.items()} == {"new_edges": 5, "unknown_protocol": 5, "interval_deviation": 7}
    assert moved == dict.fromkeys(once, 0)
    # A key twice, as a copy and with another count: copies go, the others stay.
    twice, moved = found("twice", *each, each[0], ("b", "c", None, 502, "READ", 7, 7, 8, 9000.0))
    assert {k: len(v) for k, v in twice.items()} == {"new_edges": 6, "unknown_protocol": 6, "interval_deviation": 8}
    assert all(set(once[k]) < set(twice[k]) and len(set(twice[k])) == len(twice[k]) for k in once) and min(moved.values()) > 0
    empty, _ = found("empty")
    assert empty == dict.fromkeys(once, [])


def test_zones_of_devices_are_joined_by_their_own_size(spark, edges, tmp_path):
    member = spark.createDataFrame([("a", "Field"), ("b", "Operations"), ("b", "Nowhere")], "ip string, zone_name string")
    member.coalesce(1).write.parquet(str(tmp_path / "member"))
    stored = spark.read.parquet(str(tmp_path / "member"))
    e = edges(("a", "b", "modbus", 502, "READ", 0, 0, 1), ("b", "c", "modbus", 502, "READ", 0, 0, 1))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        pairs = detect.zone_pairs(e, stored, catalog.zones_frame(spark))
        planned = pairs._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in planned and "SortMergeJoin" not in planned
        assert rows(pairs.select("src_ip", "src_zone", "dst_ip", "dst_zone")) == [("a", "Field", "b", "Operations")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_levels_and_zones(spark, edges):
    def level(*pairs):
        df = spark.createDataFrame([("d", p, n) for p, n in pairs], "ip string, protocol string, port int")
        return zones.infer_levels(df, ["ip"]).first().purdue_level

    assert [level(("modbus", 502)), level(("DNP3", 1)), level(("opc-ua", 9)), level(("https", 443))] == [1, 1, 2, 5]
    assert [level(("https", 443), ("modbus", 9)), level(("x", 1)), level(("cifs", 1)), level(("cifs", 445))] == [1, 3, 3, 4]
    e = edges(("a", "b", None, None, "x", 0, 0, 1), ("c", "a", "dns", 53, "x", 0, 0, 1))
    assert rows(zones.auto_assign_zones(e, catalog.zones_frame(spark))) == [("a", "Operations"), ("c", "Enterprise")]


def test_conduits(spark):
    c = catalog.conduits_frame(spark)
    assert rows(conduits.non_compliant_conduits(c).select("name")) == [("Field-Control",)]
    pairs = spark.createDataFrame([("Control", "Field"), ("Field", "Business")], "z1 string, z2 string")
    assert rows(conduits.conduits_for_zones(pairs, c).select("z1", "name")) == [("Control", "Field-Control")]
    one_way = c.withColumn("bidirectional", F.lit(False))
    assert conduits.conduits_for_zones(pairs, one_way).count() == 0
    uses = spark.createDataFrame([("Field-Control", "MODBUS"), ("Field-Control", "https"), ("None", "modbus")], "conduit string, protocol string")
    assert rows(conduits.assess_protocols(uses).select("protocol", "allowed")) == [("MODBUS", True), ("https", False), ("modbus", False)]


def test_fingerprint_takes_the_best_rule(spark):
    seen = spark.createDataFrame(
        [("p", "modbus", 502, "READ_HOLDING_REGISTERS"), ("p", "https", 443, None), ("q", "MODBUS", 502, None), ("r", "tcp", 1, None), ("s", "dnp3", 5, None)],
        "ip string, protocol string, port int, function_code string")
    assert rows(roles.fingerprint(seen)) == [("p", "plc", 0.85), ("q", "plc", 0.75), ("r", "unknown", 0.0), ("s", "rtu", 0.75)]
    tie = [catalog.RoleRule("first", "dnp3", confidence=0.5), catalog.RoleRule("second", None, confidence=0.5)]
    assert rows(roles.fingerprint(seen.where("ip = 's'"), rules=tie)) == [("s", "first", 0.5)]


def test_profile_modes(spark, edges):
    e = edges(("a", "b", "modbus", 502, "READ", 0, 10, 5, 250.0), ("a", "c", "modbus", 502, "READ", 0, 10, 5, 250.0),
              ("a", "d", "opc-ua", 4840, "flow", 0, 0, 1), ("b", "a", "modbus", 502, "READ", 0, 0, 1), ("c", "a", "modbus", 502, "READ", 0, 0, 1))
    devices, member = fold.fold_devices(e), spark.createDataFrame([("a", "Control")], "ip string, zone_name string")
    z = catalog.zones_frame(spark)
    exact = roles.device_profiles(e, devices, member, z).where("ip = 'a'").first()
    assert (exact.connections_out, exact.connections_in, exact.total_packets_sent, exact.total_packets_recv) == (3, 2, 11, 2)
    ref = roles.device_profiles(e, devices, member, z, "reference").where("ip = 'a'").first()
    assert (ref.connections_out, ref.connections_in, ref.total_packets_sent, ref.total_packets_recv) == (2, 1, 6, 1)
    f = roles.feature_columns(roles.device_profiles(e, devices, member, z)).where("ip = 'a'").first()
    assert (f.fan_out_ratio, f.uses_opc, f.uses_dnp3, f.interval_ms) == (0.6, 1.0, 0.0, 250.0) and len(roles.FEATURES) == 11


def test_classifier_needs_two_labels_and_caps_confidence(spark, edges):
    e = edges(*[(f"m{i}", "b", "modbus", 502, "READ", 0, 5, 10) for i in range(6)], *[(f"d{i}", "b", "dnp3", 20000, "READ", 0, 900, 3) for i in range(6)])
    p = roles.device_profiles(e, fold.fold_devices(e), spark.createDataFrame([], "ip string, zone_name string"), catalog.zones_frame(spark))
    label = F.when(F.col("ip").startswith("m"), "plc").when(F.col("ip").startswith("d"), "rtu")
    assert roles.fit(p.withColumn("label", F.when(F.col("ip").startswith("m"), "plc"))) is None
    got = {r.ip: r for r in roles.predict(p, e, roles.fit(p.withColumn("label", label))).collect()}
    assert got["m1"].role == "plc" and got["d1"].role == "rtu" and max(r.confidence for r in got.values()) <= 0.99
    assert {r.role for r in roles.predict(p, e).where("ip like 'd%'").collect()} == {"rtu"}


@pytest.mark.parametrize(("k", "margin"), [(2048, 3.0), (8, 3.0), (16, -2.0)])
def test_grouped_quantiles_equal_numpy(spark, monkeypatch, k, margin):
    """Also where the sketch is coarse, and where every bracket misses."""
    monkeypatch.setattr(stats, "SKETCH_MARGIN", margin)
    rng = np.random.default_rng(3)
    groups = {"hot": rng.uniform(100, 1000, 5000).round(2), "ties": np.repeat([5.0, 250.5, 251.0], [10, 3, 7]), "one": np.array([42.0]), "two": np.array([1.0, 2.0]),
              "signs": np.concatenate((-rng.exponential(3, 300), np.zeros(9), rng.exponential(1e6, 200), [8.0, 4.0, -8.0, 1e-300]))}
    groups[None] = np.arange(7.0)
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    got = stats.grouped_quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, k).collect()
    for r in got:
        assert np.allclose([r.q1, r.q2, r.q3], np.percentile(groups[r.k], [25, 50, 75]), rtol=0, atol=1e-9)
    assert len(got) == 6


def test_baseline_and_scores(spark, edges):
    e = edges(("a", "b", "modbus", 502, "READ", 0, 10, 100, 250.0), ("a", "c", "", 1, "x", 3, 3, 1), ("z", "c", "dns", 53, "x", -5, 3, 2))
    p = baseline.capture_baselines(e, T0, at(60), at(60)).collect()
    assert [r.ip for r in p] == ["a"]
    assert (p[0].interval_mean, p[0].interval_std, p[0].periodic_edge_count, p[0].total_edges, p[0].peer_count, p[0].protocols) == (250.0, 0.0, 1, 2, 2, ["modbus"])
    assert (p[0].packet_rate_mean, p[0].iqr_lower) == (600.0, None)
    known = spark.createDataFrame([("a", 250.0, 25.0), ("b", 250.0, 10.0), ("c", None, 0.0)], "ip string, interval_mean double, interval_std double")
    raw = F.when(F.col("ip") == "a", F.array(*[F.lit(float(v)) for v in (200, 225, 250, 275, 300)])).otherwise(F.array(F.lit(1.0)))
    low, high = stats.iqr_bounds(raw)
    few = F.size(raw) < 4
    known = known.withColumns({"iqr_lower": F.when(~few, low), "iqr_upper": F.when(~few, high)})
    seen = spark.createDataFrame([("a", 255.0), ("a", 1000.0), ("b", 280.0), ("c", 9.0), ("x", 1.0)], "ip string, observed_ms double")
    got = rows(baseline.score_intervals(seen, known).select("ip", "observed_ms", "z_anomalous", "iqr_anomalous", "iqr_upper"))
    assert got == [("a", 1000.0, True, True, 350.0), ("a", 255.0, False, False, 350.0), ("b", 280.0, False, False, float("inf")), ("c", 9.0, False, False, float("inf"))]


def test_snapshots_latest_and_age(spark, edges, tmp_path):
    e = edges(("a", "b", "modbus", 502, "READ", 0, 10, 100, 250.0))
    path = str(tmp_path / "snapshots")
    for when in (60, 120):
        baseline.save_snapshots(baseline.capture_baselines(e, T0, at(60), at(when)), fold.fold_devices(e), path)
    saved = baseline.read_snapshots(spark, path)
    assert baseline.read_snapshots(spark, path, at(100)).count() == 1 and "captured_at" in saved.columns
    assert saved.count() == 2 and rows(baseline.latest_snapshots(saved).select(F.unix_timestamp("captured_at"))) == [(int(at(120).timestamp()),)]
    assert baseline.baseline_ages(saved, at(150)).first().age_seconds == 30.0


def test_snapshots_of_all_known_devices(spark, edges, tmp_path):
    e = edges(("a", "b", "modbus", 502, "READ", 0, 10, 100, 250.0), ("c", "b", "modbus", 502, "READ", 0, 10, 100, 250.0))
    devices, path = fold.fold_devices(e), str(tmp_path / "snapshots")
    stray = edges(("x", "b", "modbus", 502, "READ", 0, 10, 100, 250.0))
    baseline.save_snapshots(baseline.capture_baselines(e.union(stray), T0, at(60), at(60)), devices, path)
    assert rows(baseline.read_snapshots(spark, path).select("ip")) == [("a",), ("c",)]
    whole = ["BASE-6-all", "BASE-7-all", "BASE-8-all", "ORD-3-all"]
    assert all("LIKE '%1'" not in registry.ORACLE[name] for name in whole) and set(whole) <= set(registry.QUERIES)


def test_coverage_report(spark, edges):
    e = edges(*[("a", "b", p, 1, "x", 0, 0, 1) for p in catalog.EXPECTED_PROTOCOLS], ("b", "a", "Modbus", 1, "x", 0, 0, 1))
    member = spark.createDataFrame([("a", "Control"), ("b", "Control")], "ip string, zone_name string")
    one = catalog.zones_frame(spark, catalog.ZONES[1:2])
    assert coverage.coverage_report(e, fold.fold_devices(e), member, one).first().coverage_score == 1.0
    worse = coverage.coverage_report(e, fold.fold_devices(e), member.where("ip = 'a'"), catalog.zones_frame(spark), ["s7", "MODBUS"]).first()
    assert worse.coverage_score == round(1 - 5 * 0.05 - 0.15 - 0.05, 3) and worse.missing_expected == ["s7"]
    quiet = edges(("a", "b", "modbus", 1, "x", 0, 0, 1))
    field = spark.createDataFrame([("b", "Field")], "ip string, zone_name string")
    stats_ = coverage.zone_statistics(quiet, field, catalog.zones_frame(spark)).first()
    assert (stats_.zone_name, stats_.device_count, stats_.inbound_edges, stats_.blind_spot) == ("Field", 1, 1, True)


def test_silence_thresholds(spark, edges):
    e = edges(*[(d, "x", "modbus", 1, "x", 0, 0, 1) for d in ("plc1", "hmi1", "odd")])
    devices = spark.createDataFrame(
        [("plc1", "PLC", at(-1200)), ("hmi1", "hmi", at(-700)), ("odd", None, at(-300)), ("mute", "plc", at(-9000)), ("edge", "plc", at(-300))],
        "ip string, role string, last_seen timestamp")
    found = coverage.silent_devices(e, devices, T0)
    assert rows(found.select("ip", "silent_for_s", "threshold_s", "severity")) == [("plc1", 1200.0, 300.0, "medium")]
    # Exactly the shortest threshold is not enough, and 0 asks for the roles'.
    assert coverage.silent_devices(e.unionByName(edges(("edge", "x", "m", 1, "x", 0, 0, 1))), devices, T0).count() == 1
    assert rows(coverage.silent_devices(e, devices, T0, override_seconds=0).select("ip")) == [("plc1",)]
    assert rows(coverage.silent_devices(e, devices, T0, override_seconds=100.0).select("ip", "severity")) == [("hmi1", "high"), ("odd", "medium"), ("plc1", "high")]
    assert rows(coverage.with_silence(devices, T0).where("is_silent").select("ip")) == [("edge",), ("mute",), ("plc1",)]


def test_attack_references(spark):
    found = spark.createDataFrame(
        [("new_devices", None, None), ("unknown_protocol", "write_single_coil", None), ("silence", None, None), ("strange", None, 5.0), ("port_scan", None, None)],
        "category string, function_code string, avg_interval_ms double")
    got = {r.category: r for r in attack.enrich(found).collect()}
    assert (got["new_devices"].technique_ids, got["new_devices"].tactic_ids) == (["T0846"], ["TA0102"])
    assert got["unknown_protocol"].technique_ids[:3] == ["T0888", "T0849", "T0869"] and "T0836" in got["unknown_protocol"].technique_ids
    assert len(set(got["unknown_protocol"].technique_ids)) == len(got["unknown_protocol"].technique_ids)
    assert got["silence"].techniques[0].tactic_name == "Inhibit Response Function"
    assert got["strange"].technique_ids[0] == "T0802" and got["port_scan"].technique_ids == ["T0840"]
    by_tactic = {r.tactic: r.findings for r in attack.summary_by_tactic(attack.enrich(found)).collect()}
    assert by_tactic["Discovery"] == 3


def greedy(steps, observed):
    matched, i = 0, 0
    for protocol, codes in steps:
        while i < len(observed):
            p, c = observed[i]
            i += 1
            if p.lower() == protocol and (not codes or c.upper() in codes):
                matched += 1
                break
    return matched


@pytest.mark.parametrize("stretch_bits", [0, 2, 10])
def test_signatures_equal_a_plain_greedy_loop(spark, edges, stretch_bits):
    rng = random.Random(stretch_bits)
    signatures = [
        catalog.Signature(f"s{k}", [catalog.Step(rng.choice("mnd"), [c for c in ("A", "B", "C") if rng.random() < 0.5]) for _ in range(n)])
        for k, n in enumerate((1, 2, 3, 4, 4))
    ]
    sequences = {f"d{i}": [(rng.choice("mndMX"), rng.choice("abCx")) for _ in range(rng.randint(1, 25))] for i in range(12)}
    e = edges(*[(ip, f"peer{j:03d}", p, 1, c, j // 2, j // 2, 1) for ip, seq in sequences.items() for j, (p, c) in enumerate(seq)])
    got = {(r.ip, r.signature_name): r.matched for r in procid.match_signatures(e, signatures, min_score=0.0, stretch_bits=stretch_bits).collect()}
    ordered = {}
    for r in procid.device_sequences(e).collect():
        ordered.setdefault(r.ip, []).append((r.protocol, r.function_code))
    assert {k: sorted(v) for k, v in ordered.items()} == {k: sorted(v) for k, v in sequences.items()}
    want = {(ip, s.name): greedy([(t.protocol, t.function_codes) for t in s.steps], seq) for ip, seq in ordered.items() for s in signatures}
    assert got == want


def test_a_hot_device_over_many_tasks(spark, edges):
    """One device has nearly all edges; its stretches meet in order wherever tasks cut them."""
    rng = random.Random(9)
    steps = [catalog.Step(p, []) for p in "abcdefab"]
    seq = [rng.choice("abcdefxyz") for _ in range(1500)]
    e = edges(*[("hot", f"p{j:04d}", p, 1, "F", j, j, 1) for j, p in enumerate(seq)], ("cold", "p", "a", 1, "F", 0, 0, 1))
    signatures = [catalog.Signature("long", steps), catalog.Signature("none", []), catalog.Signature("rare", [catalog.Step("q", []), *steps])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.ip, r.signature_name): r.matched for r in procid.match_signatures(e.repartition(7), signatures, min_score=0.0, stretch_bits=4).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {("hot", "long"): 8, ("hot", "none"): 0, ("hot", "rare"): 0, ("cold", "long"): 1, ("cold", "none"): 0, ("cold", "rare"): 0}


def test_deviation_text(spark, edges):
    e = edges(*[("a", "b", "modbus", 502, c, t, t, 1) for t, c in enumerate(["flow", "READ_COILS", "flow", "READ_HOLDING_REGISTERS"])])
    full = procid.score_matches(procid.match_signatures(e)).first()
    assert (full.signature_name, full.detail, full.flagged) == ("ModbusPollCycle", "Full match: all 2 steps matched.", False)
    half = procid.score_matches(procid.match_signatures(e.where("function_code = 'READ_COILS'"), min_score=0.5)).first()
    assert (half.deviation, half.flagged, half.detail) == (0.5, True, "Partial match: 1/2 steps matched (deviation=50%).")
    own = [catalog.Signature("own", [catalog.Step("modbus", [])] * 5)]
    unknown = procid.score_matches(procid.match_signatures(e, own)).first()
    assert (unknown.expected_steps, unknown.detail) == (0, "Acceptable match: 0/0 steps (deviation=20%).")


def test_pages_and_rules(spark, edges):
    e = edges(*[(f"10.0.0.{i}", "10.9.9.9", "modbus", 502, "READ", i, i, 1) for i in range(9)])
    devices, member = fold.fold_devices(e), spark.createDataFrame([("10.0.0.3", "Field")], "ip string, zone_name string")
    page = views.list_devices(devices, member, 3, 2).collect()
    assert [(r.ip, r.zone) for r in page] == [("10.0.0.3", "Field"), ("10.0.0.4", None)]
    with pytest.raises(ValueError):
        views.list_devices(devices, member, 0, 501)
    assert views.get_devices(devices, member, "10.1.1.1").count() == 0
    fired = policy.run_rules(e, devices, [policy.Rule("late", "edges", "packet_count = 1 AND src_ip > '10.0.0.6'"), policy.Rule("hub", "devices", "ip LIKE '10.9.%'")])
    assert rows(fired.groupBy("rule").count()) == [("hub", 1), ("late", 2)]
    stats_ = views.dashboard_stats(e, devices, member, catalog.zones_frame(spark), at(4)).first()
    assert (stats_.device_count, stats_.edge_count, stats_.new_edges, stats_.new_devices, stats_.total_findings) == (10, 9, 4, 4, 8)


def test_snapshots_saved_twice_and_latest_without_history(spark, edges, tmp_path):
    path = str(tmp_path / "snapshots")
    e = edges(("a", "b", "modbus", 502, "READ", 0, 10, 100, 250.0), ("b", "a", "modbus", 502, "READ", 0, 20, 50, 400.0))
    devices = fold.fold_devices(e)
    early, late = (baseline.capture_baselines(e, T0, at(60), at(t)) for t in (60, 120))
    only_a = late.where("ip = 'a'")
    for captured in (early, only_a, only_a, early):  # saves that are repeated, the last of an older capture
        baseline.save_snapshots(captured, devices, path)
    when = F.unix_timestamp("captured_at") - int(T0.timestamp())
    assert rows(baseline.read_snapshots(spark, path).select("ip", when)) == [("a", 120), ("a", 60), ("b", 60)]
    folder = tables.Folder(spark, path)
    folder.remove(baseline.HISTORY)
    latest = baseline.read_latest(spark, path)
    assert rows(latest.select("ip", when)) == [("a", 120), ("b", 60)] and set(latest.columns) == set(early.columns)
    assert rows(baseline.read_latest(spark, path, spark.createDataFrame([("b",), ("x",)], "ip string")).select("ip")) == [("b",)]
    assert folder.numbers("latest", "base=") == [2, 3] and [n for n in folder.names("") if n.startswith("_incoming")] == []


def test_registered_detections_flow_through(spark, edges):
    e = edges(("a", "b", "modbus", 502, "READ", 0, 10, 100, 250.0), ("b", "a", "telnet", 23, "x", 0, 20, 50, 400.0))
    devices, zones_ = fold.fold_devices(e), catalog.zones_frame(spark)
    none = spark.createDataFrame([], "ip string, zone_name string")
    added = extensions.Registry()
    twice = lambda e, d: e.where("port = 23").select("src_ip", "port").unionAll(e.where("port = 23").select("src_ip", "port"))
    added.register("telnet", twice, signal="port_scan")
    for name in ("telnet", "new_edges"):
        with pytest.raises(ValueError, match="exists already"):
            added.register(name, twice)
    found = detect.findings(e, devices, none, zones_, at(60), registry=added)
    assert {r.category: r.findings for r in detect.finding_counts(found, added).collect()}["telnet"] == 2
    told = attack.enrich(found, registry=added).where("category = 'telnet'").first()
    assert told.technique_ids == [t.technique_id for t in catalog.TECHNIQUES if "port_scan" in t.detection_signals] != []
    assert policy.run_policies(e, devices, none, zones_, at(60), registry=added)["telnet"].count() == 1
    assert detect.run_detections(e, devices, none, zones_, at(60), registry=added)["telnet"].count() == 2
    extensions.register_detection("everywhere", twice)
    try:
        assert detect.findings(e, devices, none, zones_, at(60)).where("category = 'everywhere'").count() == 2
    finally:
        extensions.DEFAULT.remove("everywhere")
    assert "everywhere" not in extensions.DEFAULT.categories


def test_a_task_reads_a_bounded_piece_of_compressed_input(spark):
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_edges_of_one_protocol_meet_the_list_in_several_tasks(spark, edges):
    e = edges(*[(f"a{i}", "b", "odd" if i else "modbus", 502, "READ", 0, 1, 2) for i in range(200)], ("n", "b", None, 1, None, 0, 1, 2))
    listed = spark.createDataFrame([("modbus",), ("modbus",), (None,)], "protocol string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = detect.unknown_protocol(e, listed, ordered=False)
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1 and sum(t["count"] for t in tasks) == 199
        assert rows(found) == rows(detect.unknown_protocol(e, ["modbus"], ordered=False))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_devices_and_training_profiles_of_the_checks_are_stored(spark, edges, tmp_path, monkeypatch):
    from checks import model_queries
    from checks.tables import Plant

    p = Plant(spark, str(tmp_path))
    p.__dict__["edges"] = edges(("10.0.0.1", "10.0.0.2", "modbus", 502, "READ", 0, 1, 2), ("10.0.0.2", "10.0.0.1", "dnp3", 20000, "READ", 0, 1, 2))
    assert p.devices.inputFiles() and rows(p.devices.select("ip")) == [("10.0.0.1",), ("10.0.0.2",)]
    asked = []
    monkeypatch.setattr(model_queries.roles, "fit", lambda profiles: asked.append(profiles.inputFiles()) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        model_queries._trained(p)
    assert asked[0]


def test_peers_of_a_baseline_are_named_devices(spark, edges):
    e = edges(("a", "b", "p", 1, "r", 0, 1, 2), ("a", "c", "p", 1, "r", 0, 1, 2), ("a", "b", "q", 2, "r", 0, 1, 2), ("a", "", "q", 1, "r", 0, 1, 2),
              ("a", None, "q", 1, "r", 0, 1, 2), ("d", "", "p", 1, "r", 0, 1, 2))
    got = baseline.capture_baselines(e, at(0), at(9), at(9)).select("ip", "peer_count", "total_edges", "protocols")
    assert rows(got) == [("a", 2, 5, ["p", "q"]), ("d", 0, 1, ["p"])]

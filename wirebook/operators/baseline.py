"""Behavioural baselines per device, and scoring against them."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook.functions import stats
from wirebook.sources import tables

Z_LIMIT = 3.0
#: Length of a baseline where none is given.
DEFAULT_WINDOW = timedelta(hours=24)
#: Folder column of the history: the time of capture in microseconds.
CAPTURE = "capture_us"
#: Folders of the snapshot table, and how the latest snapshots are dealt out.
HISTORY, LATEST, BUCKET, LATEST_BUCKETS = "history", "latest", "bucket", 32


def _at(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def edges_in_window(edges: DataFrame, start: datetime | Column, end: datetime | Column) -> DataFrame:
    """Edges that lie in the window as a whole."""
    return edges.where((F.col("first_seen") >= _at(start)) & (F.col("last_seen") <= _at(end)))


def _interval() -> Column:
    return F.when(F.col("is_periodic") & (F.col("avg_interval_ms") != 0), F.col("avg_interval_ms"))


def _rate() -> Column:
    """Packets per minute, for edges that last and have packets."""
    seconds = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / F.lit(1e6)
    usable = (seconds > 0) & (F.col("packet_count") != 0)
    return F.when(usable, F.col("packet_count") / (seconds / 60.0))


def samples(edges: DataFrame, start: datetime | Column, end: datetime | Column) -> DataFrame:
    """The single measurements behind a baseline, one row per edge.

    Kept as rows: an array of them would grow with the edges of a device.
    """
    return edges_in_window(edges, start, end).select(
        F.col("src_ip").alias("ip"),
        "dst_ip",
        "protocol",
        "port",
        "function_code",
        _interval().alias("interval_ms"),
        _rate().alias("packet_rate"),
    )


def capture_baselines(
    edges: DataFrame,
    start: datetime | Column,
    end: datetime | Column,
    captured_at: datetime | Column,
    fences: bool = True,
) -> DataFrame:
    """Baseline of every device with an outbound edge in the window.

    With ``fences`` the interquartile fences of the intervals are kept too,
    so that a stored baseline can be scored without its raw measurements.
    """
    inside = edges_in_window(edges, start, end)
    profile = inside.groupBy(F.col("src_ip").alias("ip")).agg(
        F.avg(_interval()).alias("interval_mean"),
        stats.std_pop(_interval()).alias("interval_std"),
        F.coalesce(F.avg(_rate()), F.lit(0.0)).alias("packet_rate_mean"),
        stats.std_pop(_rate()).alias("packet_rate_std"),
        F.count(_interval()).alias("periodic_edge_count"),
        F.count("*").alias("total_edges"),
    )
    # Distinct pairs first: a device has few protocols, however many edges.
    spoken = inside.select(F.col("src_ip").alias("ip"), "protocol").distinct().groupBy("ip").agg(
        F.sort_array(F.collect_set(F.when(F.col("protocol") != "", F.col("protocol")))).alias("protocols")
    )
    # Pairs of devices are nearly as many as edges; they travel without the sums.
    pairs = inside.where("dst_ip <> ''").select(F.col("src_ip").alias("ip"), "dst_ip").distinct()
    peers = pairs.groupBy("ip").agg(F.count("*").alias("peer_count"))
    profile = profile.join(spoken, "ip").join(peers, "ip", "left").withColumn("peer_count", F.coalesce("peer_count", F.lit(0).cast("bigint")))
    columns = [
        "ip",
        _at(captured_at).cast("timestamp").alias("captured_at"),
        _at(start).cast("timestamp").alias("baseline_start"),
        _at(end).cast("timestamp").alias("baseline_end"),
        "interval_mean",
        "interval_std",
        "packet_rate_mean",
        "packet_rate_std",
        "protocols",
        "peer_count",
        "periodic_edge_count",
        "total_edges",
    ]
    if not fences:
        return profile.select(*columns)
    return profile.join(interval_fences(inside), "ip", "left").select(*columns, "iqr_lower", "iqr_upper")


def interval_fences(edges: DataFrame) -> DataFrame:
    """Fences of the intervals of each device with at least four of them."""
    intervals = edges.select(F.col("src_ip").alias("ip"), _interval().alias("x")).where("x IS NOT NULL")
    enough = intervals.groupBy("ip").agg(F.count("*").alias("n")).where(F.col("n") >= stats.MIN_IQR_SAMPLES)
    quartiles = stats.grouped_quantiles(intervals, ["ip"], "x", {"q1": 0.25, "q3": 0.75})
    low, high = stats.tukey_fences(F.col("q1"), F.col("q3"))
    return quartiles.join(enough.select("ip"), "ip").select("ip", low.alias("iqr_lower"), high.alias("iqr_upper"))


def anomaly_columns(value: Column, mean: Column, std: Column, lower: Column, upper: Column) -> list[Column]:
    """Score columns of a value; null fences mean too few measurements."""
    z = stats.z_score(value, F.coalesce(mean, F.lit(0.0)), std)
    z_hit = F.abs(z) > Z_LIMIT
    iqr_hit = F.coalesce((value < lower) | (value > upper), F.lit(False))
    return [
        z.alias("z_score"),
        z_hit.alias("z_anomalous"),
        F.coalesce(lower, F.lit(0.0)).alias("iqr_lower"),
        F.coalesce(upper, F.lit(float("inf"))).alias("iqr_upper"),
        iqr_hit.alias("iqr_anomalous"),
        (z_hit | iqr_hit).alias("anomalous"),
    ]


def current_intervals(edges: DataFrame) -> DataFrame:
    """Mean interval over the periodic edges of each device."""
    return (
        edges.where("is_periodic")
        .groupBy(F.col("src_ip").alias("ip"))
        .agg(F.coalesce(F.avg("avg_interval_ms"), F.lit(0.0)).alias("observed_ms"))
    )


def score_intervals(observed: DataFrame, baselines: DataFrame) -> DataFrame:
    """Score (ip, observed_ms) against baselines; no baseline, no row."""
    fences = [c if c in baselines.columns else F.lit(None).cast("double").alias(c) for c in ("iqr_lower", "iqr_upper")]
    profile = baselines.select("ip", F.col("interval_mean").alias("baseline_mean"), "interval_std", *fences)
    return observed.join(profile, "ip").select(
        "ip",
        "observed_ms",
        "baseline_mean",
        *anomaly_columns(
            F.col("observed_ms"), F.col("baseline_mean"), F.col("interval_std"), F.col("iqr_lower"), F.col("iqr_upper")
        ),
    )


def score_all_devices(edges: DataFrame, baselines: DataFrame) -> DataFrame:
    return score_intervals(current_intervals(edges), baselines)


def save_snapshots(baselines: DataFrame, devices: DataFrame, path: str, buckets: int = LATEST_BUCKETS) -> None:
    """Store the baselines of known devices: in the history, by time of capture, and as the latest of each device.

    A capture that is saved again replaces what was stored of it, so a retried
    job changes nothing.  The latest snapshots are a table of their own with a
    row per device, dealt over ``buckets`` folders by ip; a new generation of
    it takes the place of the one before in one step.
    """
    spark = baselines.sparkSession
    incoming, folder = f"_incoming-{uuid.uuid4().hex}", tables.Folder(spark, path)
    baselines.join(devices.select("ip"), "ip", "left_semi").write.parquet(f"{path}/{incoming}")
    kept = spark.read.schema(baselines.schema).parquet(f"{path}/{incoming}")
    history = kept.withColumn(CAPTURE, F.unix_micros("captured_at")).write.mode("overwrite")
    history.option("partitionOverwriteMode", "dynamic").partitionBy(CAPTURE).parquet(f"{path}/{HISTORY}")
    latest = tables.Folder(spark, f"{path}/{LATEST}")
    before = tables.current(latest)
    rows = kept.withColumn("fresh", F.lit(True))
    if before >= 0:
        old = spark.read.parquet(f"{path}/{LATEST}/base={before}").drop(BUCKET)
        rows = rows.unionByName(old.withColumn("fresh", F.lit(False)), allowMissingColumns=True)
    newest = F.max_by(F.struct(*baselines.columns), F.struct("captured_at", "fresh")).alias("s")
    merged = rows.groupBy("ip").agg(newest).select("s.*").withColumn(BUCKET, _bucket(buckets))
    merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/{LATEST}/base={before + 1}")
    if any(n.startswith(f"{BUCKET}=") for n in latest.names(f"base={before + 1}")):
        tables.publish(latest, before + 1)
    for n in latest.numbers("", "base="):
        if n < before:
            latest.remove(f"base={n}")
            latest.remove(f"{tables.POINTER}/{n}")
    folder.remove(incoming)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("ip"), F.lit(buckets)).cast("int")


def read_snapshots(spark: SparkSession, path: str, since: datetime | Column | None = None) -> DataFrame:
    """Stored snapshots, of captures from ``since`` on."""
    stored = spark.read.parquet(f"{path}/{HISTORY}")
    if since is not None:
        stored = stored.where(F.col(CAPTURE) >= F.unix_micros(_at(since).cast("timestamp")))
    return stored.drop(CAPTURE)


def read_latest(spark: SparkSession, path: str, ips: DataFrame | None = None, buckets: int = LATEST_BUCKETS) -> DataFrame:
    """The latest snapshot of each device, or of each in ``ips``, without a look at the history.

    With ``ips`` the folders of other devices are pruned.
    """
    number = tables.current(tables.Folder(spark, f"{path}/{LATEST}"))
    latest = spark.read.parquet(f"{path}/{LATEST}/base={number}")
    if ips is not None:
        latest = latest.join(ips.select("ip").withColumn(BUCKET, _bucket(buckets)), [BUCKET, "ip"], "left_semi")
    return latest.drop(BUCKET)


def latest_snapshots(snapshots: DataFrame, ips: DataFrame | None = None) -> DataFrame:
    """Most recent snapshot of each device, or of each in ``ips``."""
    if ips is not None:
        snapshots = snapshots.join(ips.select("ip"), "ip", "left_semi")
    newest = F.max_by(F.struct(*snapshots.columns), "captured_at").alias("s")
    return snapshots.groupBy("ip").agg(newest).select("s.*")


def baseline_ages(snapshots: DataFrame, now: datetime | Column) -> DataFrame:
    """Seconds since the latest snapshot of each device."""
    age = (F.unix_micros(_at(now).cast("timestamp")) - F.unix_micros(F.max("captured_at"))) / F.lit(1e6)
    return snapshots.groupBy("ip").agg(age.alias("age_seconds"))

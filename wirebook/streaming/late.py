"""Windows over a feed stream that keep account of late rows.

Spark's own windowed aggregation drops rows behind the watermark without a
trace.  Here every batch is split by the watermark of the batches before it:
rows of windows that are still open become partial aggregates under the
batch's number, the others go to a side table.  Writing a batch again replaces
both, so a replay counts nothing twice, and every row of the feed is in one of
them for each of its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirebook.operators.windows import SLIDE, SLIDING, SPREAD_LIMIT, TUMBLING
from wirebook.schemas import BASELINE_FEED

DELAY_SECONDS = 600
KINDS = {"tumbling": (TUMBLING, TUMBLING), "sliding": (SLIDING, SLIDE)}
KEY = ["ip", "window_start", "window_end"]
PARTIAL = (
    "ip string, window_start timestamp, window_end timestamp, total_packets bigint, "
    "spread struct<n:bigint,mean:double,m2:double>, protocols array<string>"
)
BATCH = "batch bigint"


def _pairs(feed: DataFrame, kind: str) -> DataFrame:
    """A row per row and window; rows without a time have none."""
    return feed.withColumn("window", F.window(F.col("ts"), *KINDS[kind])).withColumns(
        {"window_start": F.col("window.start"), "window_end": F.col("window.end")}
    ).drop("window")


def split_late(feed: DataFrame, kind: str, watermark_us: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows with an open window, one for each, and rows of closed windows with their window.

    A window is closed when it ends at the watermark or before.  Rows without
    a time are late and have no window.
    """
    pairs = _pairs(feed, kind)
    closed = F.lit(False) if watermark_us is None else F.unix_micros("window_end") <= watermark_us
    untimed = feed.where("ts IS NULL").withColumns({c: F.lit(None).cast("timestamp") for c in KEY[1:]})
    return pairs.where(~closed), pairs.where(closed).unionByName(untimed.select(pairs.columns))


def partial_windows(pairs: DataFrame) -> DataFrame:
    """Partial aggregates of rows that know their window; they can be merged."""
    x = F.col("avg_interval_ms")
    n = F.count(x)
    return pairs.groupBy(*KEY).agg(
        F.sum("packet_count").cast("bigint").alias("total_packets"),
        F.struct(n.alias("n"), F.avg(x).alias("mean"), (F.coalesce(F.var_pop(x), F.lit(0.0)) * n).alias("m2")).alias("spread"),
        F.sort_array(F.collect_set("protocol")).alias("protocols"),
    )


def _merged(spreads: Column) -> Column:
    """Count, mean and sum of squared deviations of parts, put together."""

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(
            F.struct(
                n.alias("n"),
                (a["mean"] + gap * b["n"] / n).alias("mean"),
                (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"),
            )
        )

    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(spreads, none, add)


def merge_windows(partials: DataFrame, kind: str) -> DataFrame:
    """Windows out of partial aggregates, with the columns of the batch operators.

    A window has a part for each batch in which it was open, so the parts that
    meet here do not grow with the feed.
    """
    whole = partials.groupBy(*KEY).agg(
        F.sum("total_packets").alias("total_packets"),
        _merged(F.sort_array(F.collect_list("spread"))).alias("s"),
        F.size(F.array_distinct(F.flatten(F.collect_list("protocols")))).cast("bigint").alias("protocol_count"),
    )
    mean = F.when(F.col("s.n") > 0, F.col("s.mean"))
    if kind == "tumbling":
        return whole.select(*KEY, "total_packets", mean.alias("mean_interval_ms"), "protocol_count")
    std = F.when(F.col("s.n") > 1, F.sqrt(F.col("s.m2") / (F.col("s.n") - 1)))
    odd = F.coalesce(std.isNotNull() & (mean > 0) & (F.try_divide(std, mean) > SPREAD_LIMIT), F.lit(False))
    return whole.select(*KEY, "total_packets", mean.alias("mean_interval_ms"), std.alias("std_interval_ms"), odd.alias("anomaly_candidate"))


def _watermark(spark: SparkSession, root: str, before: int, delay_seconds: float) -> int | None:
    """Watermark in microseconds after the batches before one; a row per batch is read."""
    if before == 0:
        return None
    seen = spark.read.schema(f"newest_us bigint, {BATCH}").parquet(f"{root}/newest")
    newest = seen.where(F.col("batch") < before).agg(F.max("newest_us").alias("us")).first().us
    return None if newest is None else newest - int(delay_seconds * 1e6)


def window_batch(batch: DataFrame, batch_id: int, root: str, kind: str, delay_seconds: float) -> None:
    """Write a batch's partial windows, late rows and newest time below its number."""
    spark = batch.sparkSession
    feed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    watermark = _watermark(spark, root, batch_id, delay_seconds)
    open_, late = split_late(feed, kind, watermark)
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
    put(partial_windows(open_), "windows")
    put(late.withColumn("watermark", F.timestamp_micros(F.lit(watermark).cast("bigint"))), "late")
    put(feed.agg(F.max(F.unix_micros("ts")).alias("newest_us")), "newest")


def start_windows(
    feed: DataFrame,
    root: str,
    checkpoint: str,
    kind: str = "tumbling",
    delay_seconds: float = DELAY_SECONDS,
    trigger_seconds: int = 300,
    available_now: bool = False,
) -> StreamingQuery:
    """Run windows with a side table over a feed stream; returns the query."""
    writer = feed.writeStream.foreachBatch(lambda batch, k: window_batch(batch, k, root, kind, delay_seconds))
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{trigger_seconds} seconds"}
    return writer.trigger(**trigger).start()


def read_windows(spark: SparkSession, root: str, kind: str = "tumbling", with_late: bool = False) -> DataFrame:
    """Windows as counted so far; ``with_late`` adds the rows of the side table to theirs."""
    parts = spark.read.schema(f"{PARTIAL}, {BATCH}").parquet(f"{root}/windows").drop("batch")
    if with_late:
        parts = parts.unionByName(partial_windows(read_late(spark, root).where("window_start IS NOT NULL")))
    return merge_windows(parts, kind)


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """Rows that came behind the watermark, each with the window it missed and the watermark then."""
    feed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BASELINE_FEED if f.name != "ts")
    layout = f"{feed}, ts timestamp, window_start timestamp, window_end timestamp, watermark timestamp, {BATCH}"
    return spark.read.schema(layout).parquet(f"{root}/late")

"""Contiguous shards of near-equal bytes, with equal texts kept together.

Documents are ordered by the smallest id that has the same text, then by their
own id.  The bytes before each group of equal texts come from totals per range
partition plus a running sum inside it, and the scale from 0 to the whole is
cut at equal targets.  Groups are never split, so a shard is off its target by
one group at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirebook.sources.tables import shared_dir


def _before(rows: DataFrame, order: list[str], value: Column, name: str, within: list[str]) -> DataFrame:
    """Add the sum of ``value`` over all rows before, in the table's stored ranges.

    ``range`` numbers the ranges in order.  Only one total per range (and
    ``within``) meets in a single place; the rest runs inside the ranges.
    """
    totals = rows.groupBy(*within, "range").agg(F.sum(value).alias("_total"))
    over = Window.partitionBy(*within) if within else Window.partitionBy()
    over = over.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*within, "range", F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*within, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        summed.join(F.broadcast(bases), [*within, "range"])
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_base", "_inside")
    )


def _ranged(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """Rows in ranges of ``order``, written with their range so that it never changes."""
    ranged = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged.write.parquet(path)
    return rows.sparkSession.read.schema(ranged.schema).parquet(path)


def shard_by_bytes(docs: DataFrame, shards: int = 8, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A row's size is the UTF-8 bytes of its text plus one.  Null texts count as
    a group of their own, apart from empty ones, with size 1 and the CRC-32 of
    nothing.  Null ids come first; rows that repeat an id have slots of their
    own.  An empty table gives no rows; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    root = shared_dir(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.sha2(body, 256)).alias("group"),
    )
    rows.write.parquet(f"{root}/rows")
    rows = docs.sparkSession.read.schema(rows.schema).parquet(f"{root}/rows")
    groups = rows.groupBy("group").agg(F.min("doc_id").alias("leader"), F.sum("size").alias("bytes"))
    groups = _before(_ranged(groups, ["leader", "group"], f"{root}/groups"), ["leader", "group"], F.col("bytes"), "start", [])
    whole = rows.agg(F.sum("size")).first()[0] or 1
    middle = 2 * F.col("start").cast("decimal(38,0)") + F.col("bytes")
    shard = F.floor(middle * shards / F.lit(2 * whole)).cast("int").alias("shard")
    placed = groups.select("group", "leader", shard)
    order = ["leader", "group", "doc_id"]
    rows = _ranged(rows.join(placed, "group"), order, f"{root}/placed")
    rows = _before(rows, order, F.lit(1), "slot", ["shard"])
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

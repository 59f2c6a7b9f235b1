"""Token ids as Parquet list columns that can be read in part.

One file per range of document ids, in ascending order, with small row groups
and pages and their indexes: ids are dictionary-encoded, counters are
delta-encoded.  A reader can take the metadata columns without the ids, or
the ids of a range of documents without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirebook.llm.encoder import default_tokenizer, encoder
from wirebook.llm.words import small_batches

LAYOUT = "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids array<int>"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode every text and write the ids in ascending order of document ids.

    A null or empty text has the end id only.  Rows with a null id come first;
    rows that repeat an id follow each other, each with ids of its own.  An
    empty table gives files without rows.  Other columns are ignored.
    """
    file = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, stop, bounds, ids in encoder(file).encode(batch.column(1), end_id):
                sizes = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, stop - first),
                        pa.array(np.full(len(sizes), shard, np.int32)),
                        pa.array(start + bounds[:-1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids.view(np.int32))),
                    ],
                    names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids"],
                )
                start += int(bounds[-1])

    ordered = (
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    writer = ordered.mapInArrow(encode, LAYOUT).write
    for key, value in {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",  # counters: delta encoding
        "parquet.enable.dictionary#ids.list.element": "true",
    }.items():
        writer = writer.option(key, str(value))
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all rows before.

    Only the asked columns are read; filters on ``doc_id`` reach the page
    indexes.  The bases of the shards come from the counters alone, one row per
    file, so they may be broadcast.
    """
    rows = spark.read.schema(LAYOUT).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("start_in_shard"))
    return rows.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the stored ids as little-endian words."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.concatenate(([0], np.cumsum(np.diff(ids.offsets.to_numpy()))))
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    out = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, out)

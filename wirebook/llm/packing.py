"""Best-fit packing of documents into sequences of bounded length.

Pieces are packed best-fit-decreasing inside each partition.  Nearly full
bins leave at once; the others are items of the next round over fewer
partitions, until one partition is left or a round cannot help any more.
Two bins that are both over half full never merge, so the tree stops when the
underfull bins would not fit one task any more and are not getting fewer.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.llm.encoder import default_tokenizer, encoder
from wirebook.llm.words import small_batches
from wirebook.sources.tables import shared_dir

CAPACITY = 2048
#: Items that one task packs; bins are carried in rounds of this many partitions to one.
ITEMS_PER_TASK, FAN_IN = 30_000, 8
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
BINS = (
    "bin_id bigint, fill bigint, done boolean, members array<struct<doc_id:bigint,piece:int,start:bigint,"
    "length:bigint,ids_crc32:bigint,offset:bigint>>"
)


def cut_pieces(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Every document's ids, the end id last, cut where they exceed the capacity."""
    file = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, bounds, ids in encoder(file).encode(batch.column(1), end_id):
                ids = ids.astype("<u4", copy=False)
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = bounds[row] + start
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(at, at + length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, best fit over sizes in falling order.

    Open bins are kept by free space; a bit per free space finds the tightest.
    """
    open_bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    free = 0
    bins = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fits = free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            bin_ = open_bins[space].pop()
            if not open_bins[space]:
                free &= ~(1 << space)
        else:
            space, bin_ = capacity, []
            bins.append(bin_)
        bin_.append(i)
        if space > size:
            open_bins[space - size].append(bin_)
            free |= 1 << (space - size)
    return bins


def _pack(items: DataFrame, round_: int, capacity: int, nearly: int) -> DataFrame:
    """One round: bins of each partition; ``done`` marks the nearly full ones."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if not got:
            return
        rows = pd.concat(got, ignore_index=True)
        fills, members = rows["fill"].tolist(), rows["members"].tolist()
        base = (round_ << 52) | (TaskContext.get().partitionId() << 26)
        out: list[tuple] = []
        for k, bin_ in enumerate(best_fit(fills, capacity)):
            inside, fill = [], 0
            for i in bin_:
                inside += [{**m, "offset": m["offset"] + fill} for m in members[i]]
                fill += fills[i]
            out.append((base | k, fill, fill >= nearly, inside))
        for at in range(0, len(out), 2000):
            yield pd.DataFrame(out[at : at + 2000], columns=["bin_id", "fill", "done", "members"])

    return items.select("fill", "members").mapInPandas(pack, BINS)


def pack_pieces(
    pieces: DataFrame,
    *,
    capacity: int = CAPACITY,
    nearly: int | None = None,
    items_per_task: int = ITEMS_PER_TASK,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; sequences have no gaps.

    A piece of full capacity is a sequence by itself.  ``nearly`` is the fill
    from which a bin leaves the rounds.  Every round is written to the shared
    folder, so what a later round reads never changes.
    """
    spark = pieces.sparkSession
    nearly = capacity - capacity // 64 if nearly is None else nearly
    root = shared_dir(spark)
    pieces.write.parquet(f"{root}/pieces")
    pieces = spark.read.schema(PIECES).parquet(f"{root}/pieces")
    member = F.struct(*[c.split(" ")[0] for c in PIECES.split(", ")], F.lit(0).cast("bigint").alias("offset"))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    items = pieces.where(F.col("length") < capacity).select(
        key.alias("bin_id"), F.col("length").alias("fill"), F.array(member).alias("members")
    )
    parts = math.ceil(items.count() / items_per_task)
    before, round_, written = None, 0, []
    while parts:
        path = f"{root}/round-{round_}"
        _pack(items.repartition(parts, "bin_id"), round_, capacity, nearly).write.parquet(path)
        bins = spark.read.schema(BINS).parquet(path)
        left = bins.where("not done").count()
        fewer = max(math.ceil(left / items_per_task), math.ceil(parts / fan_in))
        last = parts == 1 or left == 0 or (fewer >= parts and before is not None and left >= before)
        written.append(bins if last else bins.where("done"))
        if last:
            break
        items, before, parts, round_ = bins.where("not done"), left, min(parts, fewer), round_ + 1
    own = pieces.where(F.col("length") >= capacity).select(
        *[c.split(" ")[0] for c in PIECES.split(", ")],
        (F.lit(1 << 60) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    for bins in written:
        inside = bins.select(F.col("bin_id").alias("sequence_id"), F.explode("members").alias("m"))
        own = own.unionByName(inside.select("m.*", "sequence_id"))
    return own


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, **options: object) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    A null or empty text is a piece of its end id; rows that repeat are packed
    each by itself; an empty table gives no rows.  Other columns are ignored.
    """
    return pack_pieces(cut_pieces(docs, capacity=capacity, **options), capacity=capacity)

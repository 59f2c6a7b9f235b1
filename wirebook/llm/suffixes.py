"""Removal of long repeated byte strings by merging sorted suffix runs.

Documents are packed into blocks of bytes.  In every ``length`` bytes the
smallest hash of ``GRAM`` consecutive bytes names an anchor, so two equal
strings have their anchor at the same place.  Anchors whose hash occurs once
are done.  The suffixes at the others, with the bytes before them, leave each
block as sorted, front-coded runs; a task merges the runs of its share of the
anchors with a loser tree that compares common-prefix lengths first and never
reads a known prefix again.  In merged order, strings that start left of an
anchor repeat where neighbours' common prefixes and the bytes before agree.
"""

from __future__ import annotations

import atexit
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirebook.llm.words import slices
from wirebook.sources.tables import shared_dir

LENGTH, GRAM = 200, 40
BLOCK_BYTES = 2 << 20
#: Anchors with more contexts than this are dealt out by each string's own bytes instead.
HOT = 20_000
#: Entries that are judged together; groups end where the common prefix is below the gram.
BATCH = 20_000
#: Anchors that one task counts, and suffixes that one task merges: a share is held decoded.
PART_ANCHORS, PART_SUFFIXES = 4_000_000, 75_000
BASE = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(2**64 - 1)
BLOCKS = "block bigint, ids binary, ends binary, blob binary, places binary, lows binary, highs binary, hashes binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each place."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    power = _powers(BASE, len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)))
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    return _mix((total[size:] - total[:-size]) * _powers(inverse, len(data) - size + 1))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of the ``size`` values from each place on."""
    done = 1
    while done < size:
        step = min(done, size - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Places of the anchors, how far before them strings may start (least, most), and their hashes.

    ``ends`` are the documents' ends in ``data``; strings never cross them.  A
    string whose smallest hash occurs several times has several anchors.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    h, wide = _rolling(data, gram), length - gram + 1
    least = _least(h, wide)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(least) + 1, np.int64)
    real = ends - starts >= length
    inside[starts[real]] += 1
    np.add.at(inside, ends[real] - length + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)  # runs of strings with the same smallest hash
    if not len(first):
        return none, none, none, none.astype(np.uint64)
    stops = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    of_run = np.cumsum(new & valid) - 1
    # In the first string of a run, all places of the smallest hash; later, those that enter at the right.
    rows, offsets = [], []
    for at in range(0, len(first), 4096):
        part = first[at : at + 4096]
        r, o = np.nonzero(h[part[:, None] + np.arange(wide)] == least[part][:, None])
        rows.append(r + at)
        offsets.append(part[r] + o)
    enter = np.flatnonzero(valid & (h[wide - 1 :][: len(least)] == least))
    run = np.concatenate([*rows, of_run[enter]])
    place = np.concatenate([*offsets, enter + wide - 1])
    key = np.unique(run * np.int64(len(data) + 1) + place)
    run, place = key // (len(data) + 1), key % (len(data) + 1)
    low = place - np.minimum(stops[run], place)
    high = place - np.maximum(first[run], place - wide + 1)
    return place, low, high, h[place]


def _blocks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of ``BLOCKS``: packed documents and their anchors; ``block`` numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at, part in slices(batch.column(1), BLOCK_BYTES):
                ends = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64))
                raw = b"".join(part.cast(pa.large_binary()).to_pylist())
                place, low, high, h = anchors(np.frombuffer(raw, np.uint8), ends, length, gram)
                ids = pa.array(batch.column(0).slice(at, len(part))).to_pylist()
                sent = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, sent.schema) as writer:
                    writer.write_batch(sent)
                values = sink.getvalue().to_pybytes(), ends.astype("<i8"), squeeze.compress(raw)
                values += tuple(x.astype("<u4") for x in (place, low, high)) + (h,)
                columns = [pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in values]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *columns], names=[x.split(" ")[0] for x in BLOCKS.split(", ")])
                number += 1

    return docs.mapInArrow(run, BLOCKS)


def _ids(raw: bytes) -> list[int | None]:
    return pa.ipc.open_stream(raw).read_all().column(0).to_pylist()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def _groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    group: list[tuple] = []
    for row in rows:
        if group and row[0] != group[0][0]:
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _repeated(blocks: DataFrame, parts: int) -> DataFrame:
    """block, hashes, hot: the hashes of a block that occur twice or more anywhere.

    A block sends each hash once, with its number of occurrences.
    """
    layout = "part int, block bigint, hashes binary, counts binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, raw in _rows(batches):
            h, n = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
            to = (h % np.uint64(parts)).astype(np.int64)
            used = [(int(p), h[to == p].tobytes(), n[to == p].astype("<u4").tobytes()) for p in np.unique(to)]
            if used:
                p, a, b = zip(*used, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([block] * len(p)), pa.array(a), pa.array(b)], names=["part", "block", "hashes", "counts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(_rows(batches)):
            own = [np.frombuffer(r[2], np.uint64) for r in group]
            every, which = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(which, np.concatenate([np.frombuffer(r[3], "<u4") for r in group]))
            ends = np.cumsum([len(h) for h in own])[:-1]
            for row, h, n in zip(group, own, np.split(total[which], ends), strict=True):
                if (n > 1).any():
                    chosen = [h[n > 1].tobytes()], [(n[n > 1] > HOT).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([row[1]]), *map(pa.array, chosen)], names=["block", "hashes", "hot"])

    sent = blocks.select("block", "hashes").mapInArrow(send, layout).repartition(parts, "part").sortWithinPartitions("part")
    return sent.mapInArrow(meet, "block bigint, hashes binary, hot binary")


def _front(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix of each of the sorted rows with the one before."""
    common = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        common[1:] = np.minimum(common[1:], np.minimum(sizes[1:], sizes[:-1]))
    return common


def encode_run(number: np.ndarray, low: np.ndarray, high: np.ndarray, right: np.ndarray, size: np.ndarray, left: np.ndarray) -> bytes:
    """A sorted run: each suffix without the prefix it shares with the one before, and the bytes before it."""
    common = _front(right, size)
    tail = np.arange(right.shape[1]) >= common[:, None]
    tail &= np.arange(right.shape[1]) < size[:, None]
    before = np.arange(left.shape[1]) < high[:, None]
    head = np.array([len(number), right.shape[1], left.shape[1]], "<u4")
    meta = [x.astype("<u4").tobytes() for x in (number, low, high, size, common)]
    return b"".join([head.tobytes(), *meta, right[tail].tobytes(), left[before].tobytes()])


def decode_run(raw: bytes) -> tuple[list, ...]:
    """number, low, high, common, tails and bytes before of a run."""
    n, _, _ = np.frombuffer(raw, "<u4", 3).tolist()
    number, low, high, size, common = (np.frombuffer(raw, "<u4", n, 12 + 4 * n * k).tolist() for k in range(5))
    at, tails, before = 12 + 20 * n, [], []
    for s, c in zip(size, common, strict=True):
        tails.append(raw[at : at + s - c])
        at += s - c
    for s in high:
        before.append(raw[at : at + s])
        at += s
    return number, low, high, common, tails, before


def merge(runs: list[tuple[list, ...]]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, place in it, suffix, common prefix with the suffix before) in sorted order.

    The tree keeps, for every loser, its common prefix with the winner that
    beat it.  Of two heads measured against the same winner, the one that
    shares more is smaller; only equal lengths need bytes, from there on.
    """
    k = len(runs)
    if not k:
        return
    heads: list[bytes | None] = [r[4][0] if r[4] else None for r in runs]
    shared = [0] * k  # with the last winner
    place = [0] * k
    loser = [-1] * k

    def beats(a: int, b: int) -> bool:
        """Whether head a is smaller; the loser's shared length becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        i, most = shared[a], min(len(x), len(y))
        if x[i:most] == y[i:most]:
            i = most
        else:
            step = most - i
            while step > 1:  # narrow down to the first difference
                half = step // 2
                if x[i : i + half] == y[i : i + half]:
                    i, step = i + half, step - half
                else:
                    step = half
        wins = (x[i] < y[i]) if i < most else (len(x) < len(y) or (len(x) == len(y) and a < b))
        shared[b if wins else a] = i
        return wins

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if not beats(a, b):
            a, b = b, a
        loser[node] = b
        return a

    winner = play(1) if k > 1 else 0
    last = 0
    while heads[winner] is not None:
        value = heads[winner]
        yield winner, place[winner], value, shared[winner] if last else 0
        last = 1
        place[winner] += 1
        run, at = runs[winner], place[winner]
        if at < len(run[4]):
            heads[winner] = value[: run[3][at]] + run[4][at]
            shared[winner] = run[3][at]
        else:
            heads[winner] = None
        node, champion = (winner + k) // 2, winner
        while node >= 1 and k > 1:
            if not beats(champion, loser[node]):
                champion, loser[node] = loser[node], champion
            node //= 2
        winner = champion


def _judge(common: np.ndarray, low: np.ndarray, high: np.ndarray, before: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and farthest start before each anchor of a string that occurs twice among these (-1: none).

    For a start ``l`` before the anchor the suffixes must share ``length - l``
    bytes, which holds within a block of neighbours, and the ``l`` bytes before.
    """
    n = len(low)
    nearest, farthest = np.full(n, -1), np.full(n, -1)
    most = int(high.max())
    left = np.frombuffer(b"".join(b.ljust(most, b"\0") for b in before), np.uint8).reshape(n, most)
    mark = np.zeros(n, np.uint64)
    for far in range(most + 1):
        if far:
            mark = mark * BASE + left[:, far - 1].astype(np.uint64) + np.uint64(1)
        live = np.flatnonzero((low <= far) & (far <= high))
        if len(live) < 2:
            continue
        block = np.cumsum(common < length - far)[live]
        key = _mix(mark[live] ^ _mix(block.astype(np.uint64)))
        turn = np.argsort(key, kind="stable")
        same = key[turn][1:] == key[turn][:-1]
        hit = np.zeros(len(live), bool)
        hit[turn[1:][same]] = True
        hit[turn[:-1][same]] = True
        found = live[hit]
        farthest[found] = far
        nearest[found[nearest[found] < 0]] = far
    return nearest, farthest


def _entries(raw: bytes, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Suffixes and the bytes before them, nearest first, as padded tables."""
    data = np.frombuffer(raw, np.uint8)
    size = length - low
    most = int(high.max()) if len(high) else 0
    at = place[:, None] + np.arange(length)
    right = np.where(np.arange(length) < size[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    at = place[:, None] - 1 - np.arange(most)
    left = np.where(np.arange(most) < high[:, None], data[np.maximum(at, 0)], 0).astype(np.uint8)
    return right, size, left


def _context_keys(raw: bytes, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """A hash of each entry's suffix, the bytes before it and where its strings start."""
    keys = []
    for at in range(0, len(place), BATCH):
        cut = slice(at, at + BATCH)
        right, _, left = _entries(raw, place[cut], low[cut], high[cut], length)
        mark = low[cut].astype(np.uint64) * BASE + high[cut].astype(np.uint64)
        for table in (right, left):
            for column in np.ascontiguousarray(table.T):
                mark = mark * BASE + column.astype(np.uint64) + np.uint64(1)
        keys.append(_mix(mark))
    return np.concatenate([np.zeros(0, np.uint64), *keys])


def _by_string(raw: bytes, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Every string of these anchors by itself: places and hashes of its bytes."""
    count = high - low + 1
    far = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.unique(np.repeat(place, count) - far)
    return at, _rolling(np.frombuffer(raw, np.uint8), length)[at]


def _send_runs(blocks: DataFrame, repeated: DataFrame, parts: int, length: int) -> DataFrame:
    """part, block, payload: a block's front-coded runs, and with part -1 the spans found inside it.

    Entries of a block that agree in all bytes are repeats already, and one of
    them is sent for the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, blob, places, lows, highs, hashes, chosen, hot in _rows(batches):
            place, low, high = (np.frombuffer(x, "<u4").astype(np.int64) for x in (places, lows, highs))
            h = np.frombuffer(hashes, np.uint64)
            wanted = np.concatenate([np.frombuffer(x, np.uint64) for x in chosen])
            busy = np.concatenate([np.frombuffer(x, bool) for x in hot])
            turn = np.argsort(wanted)
            at = turn[np.minimum(np.searchsorted(wanted, h, sorter=turn), len(wanted) - 1)]
            keep = wanted[at] == h
            place, low, high, h, busy = place[keep], low[keep], high[keep], h[keep], busy[at[keep]]
            raw = zstandard.ZstdDecompressor().decompress(blob)
            if busy.any():
                own, marks = _by_string(raw, place[busy], low[busy], high[busy], length)
                zero = np.zeros(len(own), np.int64)
                place, low, high = (np.concatenate((x[~busy], y)) for x, y in ((place, own), (low, zero), (high, zero)))
                h = np.concatenate((h[~busy], marks))
            keys, which, count = np.unique(_context_keys(raw, place, low, high, length), return_inverse=True, return_counts=True)
            twice = count[which] > 1
            spans = place[twice] - high[twice], place[twice] - low[twice] + length
            out = [(-1, block, _pack(*spans))]
            one = np.zeros(len(keys), np.int64)
            one[which[::-1]] = np.arange(len(which))[::-1]  # the first of each
            to = (h[one] % np.uint64(parts)).astype(np.int64)
            for p in np.unique(to):
                mine = one[to == p]
                for cut in range(0, len(mine), BATCH):
                    pick = mine[cut : cut + BATCH]
                    right, size, left = _entries(raw, place[pick], low[pick], high[pick], length)
                    turn = np.argsort(right.view(f"S{length}").ravel(), kind="stable")
                    turn = turn[np.lexsort((size[turn], _ranks(right[turn])))]
                    run_ = (x[turn] for x in (place[pick], low[pick], high[pick], right, size, left))
                    out.append((int(p), block, encode_run(*run_)))
            for at in range(0, len(out), 64):
                p, b, v = zip(*out[at : at + 64], strict=True)
                columns = [pa.array(p, pa.int32()), pa.array(b, pa.int64()), pa.array(v, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "payload"])

    lists = repeated.groupBy("block").agg(F.collect_list("hashes").alias("chosen"), F.collect_list("hot").alias("hot"))
    met = blocks.join(lists, "block").select("block", "blob", "places", "lows", "highs", "hashes", "chosen", "hot")
    return met.mapInArrow(run, "part int, block bigint, payload binary")


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Numbers of sorted rows, equal for equal rows."""
    differ = (rows[1:] != rows[:-1]).any(1) if len(rows) > 1 else np.zeros(0, bool)
    return np.concatenate(([0], np.cumsum(differ)))[: len(rows)]


def _pack(starts: np.ndarray, stops: np.ndarray) -> bytes:
    return starts.astype("<i8").tobytes() + stops.astype("<i8").tobytes()


def _merged(sent: DataFrame, parts: int, length: int) -> DataFrame:
    """block, payload: spans of strings that repeat between runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(_rows(batches)):
            owners, runs = [r[1] for r in group], [decode_run(r[2]) for r in group]
            pending: list[tuple[int, int, int, int, int, bytes]] = []
            most = 0
            for k, at, _, common in merge(runs):
                number, low, high, *_, before = runs[k]
                if len(pending) >= BATCH and common < length - most:
                    yield from spans(pending, owners)
                    pending, most = [], 0
                pending.append((k, number[at], low[at], high[at], common, before[at]))
                most = max(most, high[at])
            yield from spans(pending, owners)

    def spans(pending: list[tuple], owners: list[int]) -> Iterator[pa.RecordBatch]:
        if len(pending) < 2:
            return
        *numbers, before = zip(*pending, strict=True)
        k, place, low, high, common = (np.array(x, np.int64) for x in numbers)
        near, far = _judge(common, low, high, list(before), length)
        hit = np.flatnonzero(far >= 0)
        block = np.array(owners, np.int64)[k[hit]]
        start, stop = place[hit] - far[hit], place[hit] - near[hit] + length
        for b in np.unique(block):
            own = block == b
            payload = pa.array([_pack(start[own], stop[own])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), payload], names=["block", "payload"])

    rows = sent.where("part >= 0").repartition(parts, "part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "block bigint, payload binary")


def _drop(spark: SparkSession, name: str) -> None:
    """Take the blocks out of the catalog when the driver ends; their files go with the shared folder."""
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_bytes(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    with_text: bool = False,
) -> DataFrame:
    """Every row's doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    A byte goes if a string of ``length`` bytes over it also starts anywhere
    else, in any document.  Null is as empty; shorter texts stay whole; rows
    that repeat lose all they share.  ``with_text`` adds kept, the bytes that
    stay.  An empty table gives no rows; other columns are ignored.
    """
    spark, root = docs.sparkSession, shared_dir(docs.sparkSession)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def parts(rows: DataFrame, share: int) -> int:
        """So many tasks that none has more than its share of the rows' hashes, 8 bytes each."""
        total = rows.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
        return max(least, math.ceil(total / 8 / share))

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Bucketed, so that neither join by block moves the texts.
    name = f"blocks_{uuid.uuid4().hex}"
    writer = _blocks(source, length, gram).write.bucketBy(least, "block").sortBy("block")
    writer.option("path", f"{root}/blocks").option("compression", "snappy").format("parquet").saveAsTable(name)
    atexit.register(_drop, spark, name)
    blocks = spark.table(name)
    repeated = put(_repeated(blocks, parts(blocks, PART_ANCHORS)), "repeated")
    merging = parts(repeated, PART_SUFFIXES)
    sent = put(_send_runs(blocks, repeated, merging, length), "runs")
    found = put(_merged(sent, merging, length), "spans")
    spans = found.unionByName(sent.where("part < 0").select("block", "payload"))
    spans = spans.groupBy("block").agg(F.collect_list("payload").alias("spans"))
    layout = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    layout += ", kept binary" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ends, blob, payloads in _rows(batches):
            raw, stops = zstandard.ZstdDecompressor().decompress(blob), np.frombuffer(ends, "<i8")
            depth = np.zeros(len(raw) + 1, np.int64)
            for payload in payloads or ():
                both = np.frombuffer(payload, "<i8")
                np.add.at(depth, both[: len(both) // 2], 1)
                np.add.at(depth, both[len(both) // 2 :], -1)
            gone = np.cumsum(depth)[: len(raw)] > 0
            starts = np.concatenate(([0], stops[:-1]))
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            heads = starts[starts < len(raw)]
            begin[heads] = gone[heads]
            n_gone, n_begin = (np.concatenate(([0], np.cumsum(x))) for x in (gone, begin))
            data, stay = np.frombuffer(raw, np.uint8), ~gone
            kept = [data[a:z][stay[a:z]].tobytes() for a, z in zip(starts, stops, strict=True)]
            columns = [pa.array(_ids(ids), pa.int64()), pa.array(stops - starts)]
            columns += [pa.array(x[stops] - x[starts]) for x in (n_gone, n_begin)]
            columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
            columns += [pa.array(kept, pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in layout.split(", ")])

    return blocks.join(spans, "block", "left").select("ids", "ends", "blob", "spans").mapInArrow(cut, layout)

"""N-gram Jaccard join over a token-group matrix.

Documents become sets of hashed word shingles; equal sets are one set.  Sets
that share a token among their rarest ones may be similar; of these, pairs
whose parity bits differ too often cannot be and are parted, so that phrases
which many documents hold do not chain them together.  What is left is brought
together once; all others are compared with nothing.  Where sets meet, similar
ones form groups, the matrix holds each group's union of tokens, a query's
overlap with a union bounds its overlap with every member, and only groups
that reach the bound are opened.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.llm.components import components
from wirebook.llm.words import slices, small_batches, split
from wirebook.sources.tables import shared_dir

SHINGLE = 5
#: Sets link when PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Tokens are ordered by how often their bucket occurs: a table of fixed size, sent in chunks.
BUCKET_BITS, CHUNKS = 20, 64
#: Ids are looked up in a table of so many bits before their rows are shuffled.
CELLS = 1 << 24
#: Sets and tokens that one task compares at a time; larger families are dealt out in pieces.
PIECE_SETS, PIECE_TOKENS, PIVOTS = 1024, 2_000_000, 8
#: Tokens that one task matches.
PART_TOKENS = 4_000_000
#: Parity bits of a set: a power of two, no fewer than its tokens, within these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Sets that share a token and are told apart by their bits; more are a family at once.
BLOCK_SETS = 1024
#: Bytes of parity bits that one task holds, and words of them that it compares at a time.
BUCKET_BYTES, COMPARED_WORDS = 32 << 20, 1 << 20
SETS = "doc_id bigint, sig bigint, n bigint, bits binary, chunk int, counts binary"
MET = "a bigint, b bigint, id bigint, sigs array<bigint>"


def shingles(part: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted different 64-bit hashes of each text's shingles; fewer words are one shingle."""
    bounds, codes, words = split(pc.ascii_lower(part))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    flat = hashes[codes] if len(words) else np.zeros(0, np.uint64)
    mixed = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + flat[i : len(mixed) + i]
    mixed = _mix(mixed)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(mixed[a : b - size + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh64_intdigest(flat[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sig(tokens: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(tokens.tobytes()), np.uint64).view(np.int64))


def _parities(sets: list[np.ndarray]) -> list[bytes]:
    """For each set a bit per cell of its table, set if an odd number of tokens fall into the cell.

    Bits in which two sets differ are no more than the tokens in one of them
    only; halves of a table laid over each other are the table of half the size.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    wide = np.maximum(LEAST_BITS, np.minimum(MOST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)))
    ends = np.cumsum(wide)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    cell = (flat & np.repeat(wide - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(ends - wide, n)
    packed = np.packbits(np.bincount(cell, minlength=int(wide.sum())).astype(np.uint8) & 1, bitorder="little")
    return [packed[(z - w) // 8 : z // 8].tobytes() for w, z in zip(wide.tolist(), ends.tolist(), strict=True)]


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _summaries(docs: DataFrame) -> DataFrame:
    """A row per document with its set's number, size and parity bits, and token counts of each task in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents, wide = np.zeros(1 << BUCKET_BITS, np.int64), 0, 0
        for batch in batches:
            for at, part in slices(batch.column(1)):
                sets = shingles(part)
                flat = np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)
                counts += np.bincount(flat.astype(np.int64), minlength=len(counts))
                bits = _parities(sets)
                documents, wide = documents + len(bits), wide + sum(map(len, bits))
                yield _batch(SETS, batch.column(0).slice(at, len(part)), [_sig(s) for s in sets], [len(s) for s in sets], bits)
        parts = np.split(np.minimum(counts, 2**32 - 1), CHUNKS)
        used = [(k, p.astype(_least_type(p)).tobytes()) for k, p in enumerate(parts) if p.any()]
        if used:
            used.append((CHUNKS, np.array([documents, wide], "<i8").tobytes()))
            none = [None] * len(used)
            yield _batch(SETS, none, none, none, none, *zip(*used, strict=True))

    return docs.mapInArrow(run, SETS)


def _batch(layout: str, *columns: object) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    names, types = zip(*(x.split(" ") for x in layout.split(", ")), strict=True)
    columns += ([None] * len(columns[0]),) * (len(names) - len(columns))
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _among(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test for ids, null too: true for all in the column, and for few others; its table has the same size for any input."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS)).cast("int")
    size = CELLS // CHUNKS

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in batch.groupby("chunk")["cell"]:
                found.setdefault(k, np.zeros(size, bool))[cells.to_numpy() % size] = True
        if found:
            yield pd.DataFrame({"chunk": list(found), "bits": [np.packbits(x).tobytes() for x in found.values()]})

    cells = ids.select(cell(F.col(column).cast("bigint")).alias("cell"))
    cells = cells.withColumn("chunk", F.floor(F.col("cell") / size).cast("int"))
    table = np.zeros((CHUNKS, size // 8), np.uint8)
    for r in cells.repartition("chunk").mapInPandas(mark, "chunk int, bits binary").collect():
        table[r.chunk] |= np.frombuffer(r.bits, np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def test(cells: pd.Series) -> pd.Series:
        at = cells.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    known = F.pandas_udf(test, "boolean")
    return lambda c: known(cell(c.cast("bigint")))


def _least_type(numbers: np.ndarray) -> str:
    """The smallest type of numbers from 0 to 2^32 - 1 that holds these."""
    return next(f"<u{k}" for k in (1, 2, 4) if k == 4 or numbers.max(initial=0) < 1 << 8 * k)


def _order(summaries: DataFrame) -> tuple[np.ndarray, float]:
    """How often each bucket of tokens occurs, a table of the same size for any input; bytes of parity bits of a document."""
    table, total = np.zeros((CHUNKS, (1 << BUCKET_BITS) // CHUNKS), np.int64), np.zeros(2, np.int64)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch["chunk"], batch["counts"], strict=True):
                kind = "<i8" if k == CHUNKS else f"<u{len(raw) // table.shape[1]}"
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, kind).astype(np.int64)
        if sums:
            yield pd.DataFrame({"chunk": list(sums), "counts": [s.astype("<i8").tobytes() for s in sums.values()]})

    rows = summaries.where("chunk IS NOT NULL").select("chunk", "counts")
    # One job for the whole table of 8 MB.
    for r in rows.repartition("chunk").mapInPandas(add, "chunk int, counts binary").collect():
        (total if r.chunk == CHUNKS else table[r.chunk])[:] += np.frombuffer(r.counts, "<i8")
    return np.minimum(table.reshape(-1), 2**32 - 1).astype(np.uint32), total[1] / max(1, total[0])


def _prefix(n: int | np.ndarray) -> int | np.ndarray:
    """So many of a set's rarest tokens include one of any similar set's."""
    return n - -(-PERCENT * n // 100) + 1


def _candidates(docs: DataFrame, order: np.ndarray, parts: int) -> DataFrame:
    """Sets which share a token among their rarest and could be similar: blocks (id, sigs), and edges (a, b) for more than a block.

    Tokens travel as arrays, one for each slice of documents and part of the
    token space; copies inside a slice travel once.  Five bytes tell the tokens
    of a part apart and one has the place, rounded down: what meets by chance
    is parted later.  The same block has the
    same id in all parts.  Each part sends the stars of its own components, and
    the same block or edge may come from several parts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)
    blobs = "part int, tokens binary, places binary, sigs binary, sizes binary, counts binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column(1)):
                own = {_sig(s): s for s in shingles(part) if len(s)}
                chosen = []
                for tokens in own.values():
                    rank = shared.value[(tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    chosen.append(tokens[np.argsort(rank, kind="stable")[: _prefix(len(tokens))]])
                if not chosen:
                    continue
                flat = np.concatenate(chosen)
                sizes = np.fromiter(map(len, chosen), np.int64, len(chosen))
                owner = np.repeat(np.arange(len(chosen)), sizes)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                level = (place * 256 // np.repeat(sizes, sizes)).astype(np.uint8)
                to = (flat % np.uint64(parts)).astype(np.int64)
                turn = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[turn], np.arange(parts + 1))
                sigs, full = np.fromiter(own, "<i8", len(own)), np.fromiter(map(len, own.values()), "<u4", len(own))
                rows = []
                for p in np.flatnonzero(np.diff(cuts)):
                    pick = turn[cuts[p] : cuts[p + 1]]
                    used, count = np.unique(owner[pick], return_counts=True)
                    arrays = _packed(flat[pick]), level[pick], sigs[used], full[used], count.astype("<u4")
                    rows.append((int(p), *(a.tobytes() for a in arrays)))
                for at in range(0, len(rows), 64):
                    yield _batch(blobs, *map(list, zip(*rows[at : at + 64], strict=True)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.uint8, np.uint8, "<i8", "<u4", "<u4"
        for rows in _runs(batches, 1):
            token, level, sig, size, count = (np.frombuffer(b"".join(r[i + 1] for r in rows), k) for i, k in enumerate(kinds))
            token, sig, size = _unpacked(token), np.repeat(sig, count), np.repeat(size, count).astype(np.int64)
            # The first place of the level, so that no set seems to have less left than it has.
            place = level.astype(np.int64) * _prefix(size) // 256
            sig, run = _stretches(token, sig, size, place)
            wide = np.bincount(run)[run] > BLOCK_SETS
            a, b = _stars(*_to_first(sig[wide], run[wide]))
            if len(a):
                yield _batch(MET, pa.array(a), pa.array(b))
            ids, blocks = _blocks(sig[~wide], run[~wide])
            for at in range(0, len(ids), 10_000):
                few = slice(at, at + 10_000)
                none = [None] * len(ids[few])
                yield _batch(MET, none, none, pa.array(ids[few]), blocks[few])

    sent = docs.mapInArrow(send, blobs).repartition(parts, "part").sortWithinPartitions("part")
    return sent.mapInArrow(meet, MET)


def _packed(tokens: np.ndarray) -> np.ndarray:
    """The upper five bytes of each token."""
    return np.ascontiguousarray((tokens >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _unpacked(raw: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(raw) // 5, 8), np.uint8)
    whole[:, :5] = raw.reshape(-1, 5)
    return whole.view("<u8").reshape(-1)


def _need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """So many tokens sets of these sizes share at least if they link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _stretches(token: np.ndarray, sig: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of sets that share a token and could be similar if it is the first they share: the sets, and the number of each one's run.

    From the first shared token on, the overlap is at most what is left of
    either set.  Sets that fail this with their easiest partner leave; the rest
    are taken in order of size as long as the sizes of neighbours allow a link,
    so any two that could link are in one run.
    """
    turn = np.lexsort((place, sig, size, token))
    token, sig, size, place = token[turn], sig[turn], size[turn], place[turn]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
    token, sig, size, left = token[fresh], sig[fresh], size[fresh], (size - place)[fresh]
    none = np.zeros(0, np.int64)
    if len(token) < 2:
        return none, none
    run = np.cumsum(np.concatenate(([0], token[1:] != token[:-1])))
    wide = int(size.max()) + 1
    fits = (run[1:] == run[:-1]) & (PERCENT * size[1:] <= 100 * size[:-1])
    # Smallest partner of the larger set, and next partner of the smaller one.
    least = np.searchsorted(run * wide + size, run * wide + -(-PERCENT * size // 100))
    larger = (least < np.arange(len(run))) & (left >= _need(size, size[least]))
    smaller = np.append(fits & (left[:-1] >= _need(size[:-1], size[1:])), False)
    kept = np.flatnonzero(larger | smaller)
    if len(kept) < 2:
        return none, none
    a, b = kept[:-1], kept[1:]
    joined = (run[a] == run[b]) & (PERCENT * size[b] <= 100 * size[a])
    number = np.cumsum(np.append(True, ~joined)) - 1
    met = np.bincount(number)[number] > 1
    return sig[kept[met]], np.unique(number[met], return_inverse=True)[1].astype(np.int64)


def _to_first(sig: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every set of a run to the run's first, so any two are connected, over two edges at most."""
    fresh = np.ones(len(run), bool)
    fresh[1:] = run[1:] != run[:-1]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
    pairs = np.unique(np.stack([sig[first[~fresh]], sig[~fresh]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _edges(token: np.ndarray, sig: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the runs of sets that could be similar."""
    return _to_first(*_stretches(token, sig, size, place))


def _blocks(sig: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The different runs of sets, each with a number that its sets make."""
    if not len(sig):
        return np.zeros(0, np.int64), pa.array([], pa.list_(pa.int64()))
    starts = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
    ids = _mix(np.add.reduceat(_mix(sig.astype("<i8").view(np.uint64)), starts)).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(sig)), pa.int32()), pa.array(sig, pa.int64()))
    _, once = np.unique(ids, return_index=True)
    return ids[once], lists.take(pa.array(once))


def _close(sig: np.ndarray, n: np.ndarray, bits: list[np.ndarray], blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the sets of the blocks that could be similar by their parity bits: ``sig`` in order, words of bits for each.

    The bits of two sets differ in no more places than there are tokens in one
    of them only, so no similar pair is parted.  Sets that are connected
    already are not compared again.
    """
    wide = np.fromiter(map(len, bits), np.int64, len(bits))
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of so many words, of sets with these or twice as many; the row of each set."""
        if width not in tables:
            own = np.flatnonzero((wide == width) | (wide == 2 * width))
            at = np.full(len(wide), -1)
            at[own] = np.arange(len(own))
            tables[width] = np.stack([bits[i] if wide[i] == width else bits[i][:width] ^ bits[i][width:] for i in own]), at
        return tables[width]

    root = np.arange(len(sig))
    flat = np.searchsorted(sig, np.concatenate(blocks))
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    ends, pairs = np.cumsum(sizes), np.cumsum(sizes * (sizes - 1) // 2)
    at = 0
    while at < len(blocks):
        stop = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + COMPARED_WORDS, side="right")))
        base = ends[at] - sizes[at]
        later = np.repeat(ends[at:stop], sizes[at:stop]) - 1 - np.arange(base, ends[stop - 1])
        x = np.repeat(np.arange(base, ends[stop - 1]), later)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
        x, y = flat[x], flat[y]
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        open_ = (root[x] != root[y]) & (PERCENT * large <= 100 * small)
        both = np.unique(np.minimum(x, y)[open_] * len(sig) + np.maximum(x, y)[open_])
        x, y = both // len(sig), both % len(sig)
        width, most = np.minimum(wide[x], wide[y]), n[x] + n[y] - 2 * _need(n[x], n[y])
        linked = np.zeros(len(x), bool)
        for w in np.unique(width).tolist():
            rows, place = table(w)
            mine = np.flatnonzero(width == w)
            step = max(1, COMPARED_WORDS // w)
            for few in (mine[i : i + step] for i in range(0, len(mine), step)):
                differ = np.bitwise_count(rows[place[x[few]]] ^ rows[place[y[few]]]).sum(1, dtype=np.int64)
                linked[few] = differ <= most[few]
        known = np.flatnonzero(root != np.arange(len(root)))
        a, b = _stars(np.concatenate((known, x[linked])), np.concatenate((root[known], y[linked])))
        root[a] = b
        at = stop
    moved = np.flatnonzero(root != np.arange(len(root)))
    return sig[moved], sig[root[moved]]


def _links(met: DataFrame, summaries: DataFrame, many: int, put: object) -> DataFrame:
    """Edges (a, b) that join all sets which could be similar by their parity bits, from the blocks of sets.

    The blocks are dealt out in so many buckets by their numbers, and a set's
    bits go once to each bucket where it is met, whatever the number of its
    blocks there.
    """
    blocks = put(met.where("id IS NOT NULL").select("id", "sigs").dropDuplicates(["id"]), "blocks")
    blocks = blocks.withColumn("bucket", F.pmod("id", F.lit(many)).cast("int"))
    needed = blocks.select("bucket", F.explode("sigs").alias("sig")).distinct()
    known = summaries.where("n > 0").groupBy("sig").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    # Sets grow with the documents: never sent whole, so that the plan is the same at every size.
    rows = needed.join(known.hint("merge"), "sig").select("bucket", "sig", "n", "bits", F.lit(None).cast("array<bigint>").alias("sigs"))
    rows = rows.unionByName(blocks.select("bucket", "sigs"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 1):
            sets = sorted(r[1:4] for r in group if r[1] is not None)
            sig, n = np.array([r[0] for r in sets], np.int64), np.array([r[1] for r in sets], np.int64)
            a, b = _close(sig, n, [np.frombuffer(r[2], "<u8") for r in sets], [np.array(r[4], np.int64) for r in group if r[4] is not None])
            if len(a):
                yield _batch("a bigint, b bigint", pa.array(a), pa.array(b))

    close = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint")
    return met.where("id IS NULL").select("a", "b").unionByName(close)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest of its component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        for side in (root[a], root[b]):
            np.minimum.at(root, side, low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that follow each other with the same first ``keys`` columns."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:keys] != rows[0][:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def resolve(sets: list[np.ndarray]) -> list[int]:
    """A number for each set, equal for sets joined by links among these.

    Queries come in rising size.  ``matrix`` has the groups whose union holds a
    token; a group is opened if the query may share enough tokens with it and
    is not in the query's component yet.
    """
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    tokens, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    common = count > 1
    number = np.cumsum(common) - 1
    codes = []
    for a, z in zip(ends, ends[1:], strict=False):
        c = code[a:z]
        codes.append(number[c[common[c]]])
    matrix: list[list[int]] = [[] for _ in range(int(common.sum()))]
    members: list[list[int]] = []
    unions: list[set[int]] = []
    marked = np.zeros(len(matrix), bool)
    for q in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        n, own = len(sets[q]), codes[q]
        if 100 * len(own) < PERCENT * n or not n:
            continue  # too few tokens are shared with anything
        names = own.tolist()
        bound = Counter(chain.from_iterable(matrix[c] for c in names))
        marked[own] = True
        home = None
        for g, overlap in bound.most_common():
            if 100 * overlap < PERCENT * n:
                break
            if find(members[g][0]) == find(q):
                continue
            for r in reversed(members[g]):
                size = len(sets[r])
                if 100 * size < PERCENT * n:
                    break  # members joined in rising size
                same = int(np.count_nonzero(marked[codes[r]]))
                if 100 * same >= PERCENT * (n + size - same):
                    root[find(q)] = find(r)
                    home = g if home is None else home
                    break
        marked[own] = False
        if home is None:
            home = len(members)
            members.append([])
            unions.append(set())
        members[home].append(q)
        for c in names:
            if c not in unions[home]:
                unions[home].add(c)
                matrix[c].append(home)
    return [find(i) for i in range(len(sets))]


def _compare(rows: DataFrame) -> DataFrame:
    """Rows of (family, piece, turn, sig, text): edges from every set to the first of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3):
            texts = pa.array([r[4] for r in group], pa.large_string())
            found = resolve([s for _, part in slices(texts) for s in shingles(part)])
            first: dict[int, int] = {}
            for r, k in zip(group, found, strict=True):
                first[k] = min(r[3], first.get(k, r[3]))
            columns = [r[0] for r in group], [r[1] for r in group], [r[3] for r in group], [first[k] for k in found]
            yield _batch("family bigint, piece int, a bigint, b bigint", *columns)

    key = ["family", "piece", "turn"]
    rows = rows.select(*key, "sig", "text").repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(run, "family bigint, piece int, a bigint, b bigint")


def _pieces(sets: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(sets / PIECE_SETS), F.ceil(tokens / PIECE_TOKENS)).cast("int")


def _across(local: DataFrame, rows: DataFrame, put: object) -> DataFrame:
    """Edges of families in several pieces, from what was found inside the pieces.

    Some sets of each piece's largest component are compared first, which joins
    the bulk of a family.  Sets outside the family's largest component then
    visit every other piece; two sets inside it need no comparison.
    """
    none = F.lit(0).alias("turn")
    size = local.groupBy("family", "piece", "b").agg(F.count("*").alias("size"))
    top = size.groupBy("family", "piece").agg(F.max_by("b", F.struct("size", "b")).alias("b"))
    few = local.join(top, ["family", "piece", "b"]).groupBy("family", "piece")
    few = few.agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("a"), F.lit(997)) < 16 * PIVOTS, F.col("a")))), 1, PIVOTS).alias("some"), F.min("a").alias("one"))
    few = few.select("family", F.explode(F.array_distinct(F.concat("some", F.array("one")))).alias("sig"))
    deal = F.pmod(F.xxhash64("sig"), F.ceil(F.col("many") / PIECE_SETS)).cast("int").alias("piece")
    counted = few.join(few.groupBy("family").agg(F.count("*").alias("many")), "family")
    pivots = counted.select("family", "sig", deal).join(rows.select("sig", "text"), "sig")
    edges = put(local.select("a", "b").unionByName(_compare(pivots.select("*", none)).select("a", "b")), "inside")
    labels = components(edges)
    whole = local.select("family", F.col("a").alias("id")).join(labels, "id", "left")
    whole = whole.select("family", F.col("id").alias("sig"), F.coalesce("label", "id").alias("label"))
    main = whole.groupBy("family", "label").agg(F.count("*").alias("size"))
    main = main.groupBy("family").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    rest = put(whole.join(main, "family").where("label <> main").select("family", "sig"), "rest")
    visits = rest.join(rest.groupBy("family").agg(F.count("*").alias("many")), "family")
    visits = visits.select("family", "sig", F.ceil(F.col("many") / PIECE_SETS).cast("int").alias("turns"))
    turns = visits.select("family", "turns").distinct()
    visits = visits.join(rows.select("sig", "piece", "pieces", "text"), "sig")
    turn = F.pmod(F.xxhash64("sig"), F.col("turns")).cast("int").alias("turn")
    visits = visits.select("family", "sig", "text", turn, F.col("piece").alias("home"), F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"))
    hosts = rows.join(turns, "family").select("family", "piece", F.explode(F.expr("sequence(0, turns - 1)")).alias("turn"), "sig", "text")
    met = hosts.unionByName(visits.where("home <> piece").drop("home"))
    return edges.unionByName(_compare(met).select("a", "b"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row, sig, the number of its set, and label, that of its component.

    A-Z are lower-cased; words are runs without ASCII white space; a text of
    fewer words than a shingle is one shingle, a text without words (or null)
    has none and links with nothing, so its component is its own id.  Equal
    sets are linked.  A component's id is its smallest document id, null only
    if none has one.  Rows that repeat stay; an empty table gives no rows.
    Sets and tokens are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    root = shared_dir(spark)

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    source = _read(docs, doc_id, text)
    summaries = put(_summaries(source), "summaries")
    mine = summaries.where("chunk IS NULL").select("doc_id", "sig", "n")
    # A part holds so many rare tokens at most, whatever the size of the corpus.
    order, size = _order(summaries)
    rare, least = int(order.sum(dtype=np.int64)) * (100 - PERCENT) // 100, int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil(rare / PART_TOKENS))
    met = put(_candidates(source, order, parts), "met")
    # No set is met at more places than it has rare tokens.
    edges = _links(met, summaries, max(4 * least, math.ceil(rare * size / BUCKET_BYTES)), put)
    families = put(components(edges), "families").select(F.col("id").alias("sig"), F.col("label").alias("family"))
    firsts = mine.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    chosen = families.join(firsts, "sig")
    sized = chosen.groupBy("family").agg(_pieces(F.count("*"), F.sum("n")).alias("pieces"))
    piece = F.pmod(F.xxhash64("sig"), F.col("pieces")).cast("int").alias("piece")
    chosen = put(chosen.join(sized, "family").select("family", "sig", "doc_id", "pieces", piece), "chosen")
    # Texts of other ids are not shuffled.
    texts = source.where(_among(chosen, "doc_id")(F.col("doc_id"))).withColumnRenamed("doc_id", "id")
    # Of rows that repeat an id with other texts, the set's own text is told by its shingles.
    # The sets are never sent whole: the plan is the same at every size, and a task looks ids up or reads texts, not both.
    rows = _of_sets(chosen.hint("merge").join(texts, F.col("doc_id").eqNullSafe(F.col("id"))))
    rows = put(rows, "rows")
    sized = chosen.select("family", "pieces").distinct()
    local = put(_compare(rows.withColumn("turn", F.lit(0))).join(sized, "family"), "local")
    links = local.where("pieces = 1").select("a", "b")
    if local.where("pieces > 1").head(1):
        wide = rows.where("pieces > 1")
        links = links.unionByName(components(_across(local.where("pieces > 1"), wide, put)).select(F.col("id").alias("a"), F.col("label").alias("b")))
    label = links.groupBy(F.col("a").alias("sig")).agg(F.min("b").alias("label"))
    sets = firsts.select("sig", "doc_id").join(label, "sig", "left").select("sig", "doc_id", F.coalesce("label", "sig").alias("label"))
    smallest = sets.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    sets = sets.join(smallest, "label").select("sig", "component_id", "label")
    linked = mine.where("n > 0").join(sets, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "sig", "label")
    alone = mine.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "sig")
    return linked.unionByName(alone.withColumn("label", F.lit(None).cast("bigint")))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all columns, and every row without words.

    It is a row with the component's smallest id (null last) and, of several
    texts with that id, the set of smallest number; of equal rows any one.
    Rows that repeat an id, or have none, are told apart by the sets of their
    texts.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    root = shared_dir(spark)

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    groups = put(near_duplicates(docs, doc_id=doc_id, text=text), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("f")
    chosen = groups.where("n_shingles > 0").groupBy("label").agg(first).select("f.doc_id", "f.sig")
    ids = chosen.select("doc_id").unionByName(groups.where("n_shingles = 0").select("doc_id")).distinct()
    many = groups.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("many"))
    known = many.join(ids.withColumn("wanted", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    known = known.select(F.struct("id", (F.col("many") > 1).alias("shared"), F.coalesce("wanted", F.lit(False)).alias("wanted")).alias("_known"))
    known = put(known, "known")
    # Most ids have one row, which stays: only rows of other ids are shuffled.
    among = _among(known.where("_known.shared OR NOT _known.wanted").select("_known.id"), "id")(docs[doc_id])
    # Ids grow with the documents: never sent whole, so that the plan is the same at every size.
    met = docs.where(among).join(known.where("_known.wanted").hint("merge"), docs[doc_id].cast("bigint").eqNullSafe(F.col("_known.id")))
    out = docs.where(~among).unionByName(met.where("NOT _known.shared").select(*[docs[c] for c in docs.columns]))
    if known.where("_known.shared AND _known.wanted").limit(1).count() == 0:
        return out
    rows = met.where("_known.shared").select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("_known.id").alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(2)):
                sets = shingles(part)
                numbers = pa.array([_sig(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(part)) for i in (0, 1)), *numbers], names=["row", "doc_id", "sig", "n"])

    told = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, doc_id bigint, sig bigint, n bigint")
    wanted = chosen.select(F.col("doc_id").alias("id"), F.col("sig").alias("own"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sig") == F.col("own"))
    picked = told.where("n > 0").join(wanted, same, "left_semi").dropDuplicates(["doc_id", "sig"])
    return out.unionByName(picked.select("row.*")).unionByName(told.where("n = 0").select("row.*"))


def _of_sets(rows: DataFrame) -> DataFrame:
    """Rows whose text has the wanted set, one for each set."""
    layout = "family bigint, sig bigint, pieces int, piece int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(4)):
                right = [_sig(s) == w for s, w in zip(shingles(part), batch.column(1).slice(at, len(part)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.slice(at, len(part)).filter(pa.array(right)) for c in batch.columns], names=batch.schema.names)

    picked = rows.select("family", "sig", "pieces", "piece", "text").mapInArrow(run, layout)
    return picked.dropDuplicates(["sig"])

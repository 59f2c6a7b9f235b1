"""Words of text columns, split and numbered inside Arrow.

A word is a maximal run of characters other than the six ASCII white-space
characters.  Splitting and numbering run in Arrow's kernels over a slice of a
column, so Python sees each different word of a slice once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Text handled at a time, so that memory follows this and the longest document.
SLICE_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Let Spark hand texts to Python in small batches, so that neither side holds many of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) with parts of about ``limit`` bytes; nulls are empty texts.

    Parts start at the start of their buffers, as Arrow's kernels for case do
    not heed other offsets.
    """
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, _rebased(column.slice(at, stop - at))
        at = stop


def _rebased(part: pa.Array) -> pa.Array:
    offsets = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, 8 * part.offset)
    data = part.buffers()[2] or pa.py_buffer(b"")
    own = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets - offsets[0]), own)


def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word bounds of each text, the words as numbers, and the words by number."""
    lists = pc.ascii_split_whitespace(column)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in words:  # white space at either end of a text
        real = codes != words.index("")
        bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
        codes = codes[real]
    return bounds.astype(np.int64), codes, words

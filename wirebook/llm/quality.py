"""Quality rules: counts per text, and a log-likelihood ratio of hashed n-grams.

Three bytes at a time, whole texts are hashed into a fixed number of buckets.
The trusted target is every document labelled good, the raw corpus is every
document.  A document's score is the mean, over all its n-grams, of the log
ratio of the two smoothed multinomials.  Weights are integers, so sums do not
depend on how rows are dealt out and the threshold decides the same each time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.llm.words import slices, small_batches, split

GRAM, BUCKETS, SCALE = 3, 1 << 16, 1 << 20
#: Bytes whose n-grams are laid out at a time.
SLICE = 1 << 20
#: Least mean log ratio of a document that is kept, in nats for each n-gram.
THRESHOLD = -0.25
SMOOTHING = 1.0
#: Good labels up to which their ids are sent to every executor; beyond it the texts are shuffled by id.
BROADCAST_LABELS = 1_000_000
SYMBOLS = r"[#*$%&|<>]"
BLANK = " \t\n\v\f\r"
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _grams(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and the bounds of each text's n-grams.

    N-grams do not cross texts; a text shorter than an n-gram has none.
    """
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False)))).astype(np.int64)
    first = int(np.frombuffer(part.buffers()[1], "<i8", 1, 8 * part.offset)[0]) if len(part) else 0
    data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[first : first + ends[-1]].astype(np.uint32)
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    code = np.zeros(len(data) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        code = (code << np.uint32(8)) | data[i : len(code) + i]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    inside = np.ones(len(bucket), bool)
    for back in range(1, GRAM):
        crossing = ends[1:-1] - back
        inside[crossing[(crossing >= 0) & (crossing < len(bucket))]] = False
    kept = np.concatenate(([0], np.cumsum(inside)))
    return bucket[inside], kept[np.minimum(ends, len(bucket))]


def _repeats(bounds: np.ndarray, codes: np.ndarray, n_codes: int) -> np.ndarray:
    """Words of each text inside three-word windows that the text has twice or more."""
    out = np.zeros(len(bounds) - 1, np.int64)
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if b - a < 4:
            continue
        w = codes[a:b].astype(np.int64)
        pair = w[:-1] * n_codes + w[1:]
        if n_codes > 2_000_000:  # keep the product below 2**63
            pair = np.unique(pair, return_inverse=True)[1]
        _, which, counts = np.unique(pair[:-1] * n_codes + w[2:], return_inverse=True, return_counts=True)
        twice = counts[which] > 1
        if twice.any():
            hit = np.zeros(b - a, bool)
            for i in range(3):
                hit[i : len(twice) + i] |= twice
            out[k] = hit.sum()
    return out


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def _base(part: pa.Array) -> list[np.ndarray]:
    bounds, codes, words = split(part)
    sizes = pc.utf8_length(pa.array(words, pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes[codes]))) if len(codes) else np.zeros(1, np.int64)
    return [
        np.diff(bounds),
        np.diff(ends[bounds]),
        pc.count_substring_regex(part, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        np.array([_dup_lines(t) for t in part.to_pylist()], np.int64),
        _repeats(bounds, codes, max(1, len(words))),
    ]


def corpus_counts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", good: str = "quality") -> DataFrame:
    """bucket, target, raw: n-gram counts of the documents labelled good and of all.

    Each task adds up its own rows; at most a row per bucket and task is shuffled.
    """
    small_batches(docs.sparkSession)
    trusted = labels.where(F.col(good) == 1).select(F.col(doc_id).cast("bigint").alias("id")).distinct()
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    trusted = trusted.withColumn("good", F.lit(True))
    if trusted.count() <= BROADCAST_LABELS:
        trusted = F.broadcast(trusted)
    marked = rows.join(trusted, "id", "left").select("good", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good_rows = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False)
            for at, part in slices(batch.column(1), SLICE):
                bucket, bounds = _grams(part)
                totals[1] += np.bincount(bucket, minlength=BUCKETS)
                chosen = np.repeat(good_rows[at : at + len(part)], np.diff(bounds))
                totals[0] += np.bincount(bucket[chosen], minlength=BUCKETS)
        used = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(totals[0][used]), pa.array(totals[1][used])],
            names=["bucket", "target", "raw"],
        )

    parts = marked.mapInArrow(count, "bucket int, target bigint, raw bigint")
    return parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def weights(counts: DataFrame) -> np.ndarray:
    """Integer log ratios by bucket; at most ``BUCKETS`` rows reach the driver.

    Without trusted documents every weight is zero and all texts pass.
    """
    rows = counts.toPandas()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    target[rows["bucket"]], raw[rows["bucket"]] = rows["target"], rows["raw"]
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    share = [np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS)) for c in (target, raw)]
    return np.rint((share[0] - share[1]) * SCALE).astype(np.int64)


def judge(
    docs: DataFrame,
    weight: np.ndarray,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Rows as struct ``row`` (all columns or ``keep``) with the counts, base_failed, llr and kept.

    A text without n-grams has llr null and passes the ratio (the word count
    fails it); null is as empty.  Equal texts have equal results, rows that
    repeat stay.
    """
    limit = int(round(threshold * SCALE))
    small_batches(docs.sparkSession)
    cast = F.col(text).cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), cast.alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()
    names = [c.split(" ")[0] for c in BASE.split(", ")]
    model = docs.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.value
        for batch in batches:
            for at, part in slices(batch.column(1), SLICE):
                base = _base(part)
                bucket, bounds = _grams(part)
                sums = np.diff(np.concatenate(([0], np.cumsum(value[bucket])))[bounds])
                n = np.diff(bounds)
                failed = (base[0] < 50) | (100 * base[4] > 50 * base[0])
                llr = pa.array(sums / (np.maximum(n, 1) * SCALE), mask=n == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)),
                        *map(pa.array, base),
                        pa.array(failed),
                        llr,
                        pa.array(~failed & (sums >= limit * n)),
                    ],
                    names=["row", *names, "base_failed", "llr", "kept"],
                )

    return rows.mapInArrow(run, f"row {row_type}, {BASE}, base_failed boolean, llr double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """``judge`` with the weights of ``corpus_counts`` over the same documents.

    Labels of unknown documents, null labels and null ids count for nothing;
    without good labels only the base rules decide.  An empty table of
    documents gives no rows.
    """
    return judge(docs, weights(corpus_counts(docs, labels)), **options)

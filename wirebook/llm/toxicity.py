"""Toxicity by compression distance under two zstandard dictionaries.

From a bounded sample of labelled documents one dictionary is made of toxic
and one of ordinary text: of the words, or beginnings of words, that toxic
documents hold more often than chance allows, and of the most frequent of the
others.  A window is a word between blanks.  It is compressed under either
dictionary, and the two lengths pick a cell of a table of log ratios, counted
over the sample.  The cells that speak for toxic text are added up over a
document's different windows and calibrated against its number of windows,
so that the best cut of the sample is at a score of 0.3.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.llm.language import held_out
from wirebook.llm.words import slices, small_batches, split

#: Documents of each class to learn from, taken by a hash of their ids, and their longest text.
FIT_DOCS, FIT_CHARS = 1500, 20_000
#: Score from which a document is called toxic.
CUT = 0.3
TOXIC_BYTES, ORDINARY_BYTES = 16 << 10, 32 << 10
#: Shortest beginning of a word that is counted by itself.
HEAD = 4
#: Longest window; longer words are cut in overlapping ones.
WINDOW = 64
#: Both ends of a window, so that it is long enough to be searched to its end and never stored raw.
PAD = bytes(16)
LEVEL, LEAST_MATCH = 9, 5
#: Cells by how many bytes the toxic dictionary saves, and how many it needs beyond an empty window.
SAVED, LEFT = 24, 24
#: Log ratio from which a cell speaks for toxic text.
TELLING = 1.0
KNOWN_WORDS = 300_000
#: Most log odds of a document without such a window: a score of 0.14.
NOTHING = math.log(CUT / (1 - CUT)) - 1


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    cells: np.ndarray
    weights: tuple[float, float, float]


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", size: int = FIT_DOCS, longest: int = FIT_CHARS) -> pd.DataFrame:
    """text and toxic of at most ``size`` documents of each class, none held out.

    The ids are chosen among the labels, so documents are read once and none
    is shuffled; of rows that repeat an id one is taken.  A document with
    several labels is toxic if one says so.
    """
    known = labels.select(F.col(doc_id).cast("bigint").alias("id"), F.col(toxic).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    turn = F.xxhash64("id"), F.col("id")
    chosen = known.where("toxic = 1").orderBy(*turn).limit(size).unionByName(known.where("toxic <> 1").orderBy(*turn).limit(size))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where(F.length("text") <= longest)
    # At most two times ``size`` ids.
    met = rows.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    return met.toPandas().sort_values("id")[["text", "toxic"]]


def _words(texts: Iterable[str]) -> list[list[bytes]]:
    """The words of each text in order, lower-cased."""
    out = []
    for _, part in slices(pa.array(list(texts), pa.large_string())):
        bounds, codes, words = split(pc.utf8_lower(part))
        known = [w.encode("utf-8", "surrogatepass") for w in words]
        out += [[known[c] for c in codes[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


def _fresh(docs: list[list[bytes]]) -> list[list[bytes]]:
    """Different words of each document that follow a word they have not followed in a document before.

    So copies of a document, whole or in part, count once.
    """
    met: set[tuple[bytes, bytes]] = set()
    out = []
    for words in docs:
        pairs = set(zip([b"", *words], words, strict=False)) - met
        met |= pairs
        out.append(sorted({w for _, w in pairs}))
    return out


def _heads(word: bytes) -> list[bytes]:
    text = word.decode("utf-8", "ignore")
    return [text[:k].encode() for k in range(HEAD, len(text))] + [word + b" "]


def _surprise(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Likelihood ratio of a of na against b of nb; 0 where toxic documents do not have more."""

    def part(seen: np.ndarray, due: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(due, 1e-9)), 0)

    share = (a + b) / (na + nb)
    value = 2 * (part(a, na * share) + part(b, nb * share) + part(na - a, na * (1 - share)) + part(nb - b, nb * (1 - share)))
    return np.where(a * nb > b * na, value, 0)


def _dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Contents of the two dictionaries, the most telling last, as near matches are cheap."""
    counts = []
    for docs in (toxic, ordinary):
        counted: Counter[bytes] = Counter()
        for words in docs:
            counted.update({h for w in words for h in _heads(w)})
        counts.append(counted)
    names = [h for h, n in counts[0].items() if n > 1]
    a = np.array([counts[0][h] for h in names], float)
    b = np.array([counts[1][h] for h in names], float)
    found = _surprise(a, b, sum(map(bool, toxic)), sum(map(bool, ordinary)))
    # Beyond what the best of so many names would reach by chance.
    enough = 2 * math.log(max(2, len(names)))
    value = {h: v for h, v in zip(names, found.tolist(), strict=True) if v > enough}
    worth: dict[bytes, float] = {}
    for words in toxic:
        for w in words:
            if w not in worth:
                worth[w] = max((value.get(h, 0.0) for h in _heads(w)), default=0.0)
    telling = sorted((w for w, v in worth.items() if v), key=lambda w: (worth[w], w))
    plain = Counter(w for words in ordinary for w in words if not worth.get(w))
    common = [w for w, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0]))[:ORDINARY_BYTES]][::-1]
    join = lambda words, size: (b" " + b" ".join(words) + b" ")[-size:]
    return join(telling, TOXIC_BYTES), join(common, ORDINARY_BYTES)


class Compressor:
    """Cells of words under the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.by = [self._compressor(c) for c in (ordinary, toxic)]
        self.least = self._length(1, b"")

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            source_size=WINDOW + 2 * len(PAD),
            dict_size=len(content),
            min_match=LEAST_MATCH,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        given.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=given, compression_params=settings)

    def _length(self, which: int, window: bytes) -> int:
        return len(self.by[which].compress(PAD + window + PAD))

    def cells(self, word: bytes) -> list[int]:
        out = []
        full = b" " + word + b" "
        for at in range(0, max(1, len(full) - WINDOW // 2), WINDOW // 2):
            window = full[at : at + WINDOW]
            ordinary, toxic = self._length(0, window), self._length(1, window)
            saved = min(SAVED - 1, max(0, ordinary - toxic))
            out.append(saved * LEFT + min(LEFT - 1, max(0, toxic - self.least)))
        return out


def _features(words: list[list[bytes]], worth: dict[bytes, float]) -> np.ndarray:
    rows = [(sum(worth[w] for w in set(doc)), math.log1p(len(set(doc)))) for doc in words]
    return np.array(rows, float).reshape(-1, 2)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a little shrinkage, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    keep = np.diag([1e-6, 1e-2, 1e-2])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _best_cut(value: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, midway between the values on both sides."""
    turn = np.argsort(-value, kind="stable")
    value, hits = value[turn], np.cumsum(y[turn])
    ends = np.flatnonzero(np.append(np.diff(value) != 0, True))
    k = ends[np.argmax(2 * hits[ends] / (ends + 1 + y.sum()))]
    return float((value[k] + value[min(k + 1, len(value) - 1)]) / 2)


def train(rows: pd.DataFrame) -> Model | None:
    """Dictionaries, table and calibration from texts and labels; None unless both classes are there."""
    y = (rows["toxic"].to_numpy() == 1).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    words = _words(rows["text"])
    sides = [_fresh([w for w, t in zip(words, y, strict=True) if t == k]) for k in (1, 0)]
    toxic, ordinary = _dictionaries(*sides)
    by = Compressor(toxic, ordinary)
    cells = {w: by.cells(w) for w in {w for doc in words for w in doc}}
    seen = np.zeros((2, SAVED * LEFT))
    for k, side in zip((1, 0), sides, strict=True):
        seen[k] = np.bincount([c for doc in side for w in doc for c in cells[w]], minlength=SAVED * LEFT)
    share = seen.sum(1) / max(1.0, seen.sum())
    ratio = np.log((seen[1] + 10 * share[1]) / (seen[0] + 10 * share[0] + 1e-9) * share[0] / max(share[1], 1e-9))
    ratio[:LEFT] = 0  # nothing saved by the toxic dictionary
    table = np.where(ratio >= TELLING, ratio, 0.0)
    worth = {w: max(table[c] for c in found) for w, found in cells.items()}
    x = _features(words, worth)
    w = _logistic(x, y)
    w[0] += math.log(CUT / (1 - CUT)) - _best_cut(w[0] + x @ w[1:], y)
    return Model(toxic, ordinary, table, tuple(w.tolist()))


def score(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows as struct ``row`` (all columns or ``keep``) with score, predicted and the array ``found``.

    ``found`` has the different words that speak for toxic text.  A null
    text is as empty.  A text without such words, or without words, is below
    the cut.  Whole texts are read, rows that repeat stay, an empty table
    gives no rows.  Without a model every score is 0.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    layout = f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int, found array<string>"
    if model is None:
        none = F.array().cast("array<string>")
        return rows.select("row", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), none.alias("found"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, ordinary, table, weights = shared.value
        by, known = Compressor(toxic, ordinary), {}
        for batch in batches:
            for at, part in slices(batch.column(1)):
                bounds, codes, words = split(pc.utf8_lower(part))
                if len(known) > KNOWN_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = max(table[c] for c in by.cells(w.encode("utf-8", "surrogatepass")))
                worth = np.fromiter((known[w] for w in words), float, len(words))
                values, found = [], []
                for a, b in zip(bounds, bounds[1:], strict=False):
                    own = np.unique(codes[a:b])
                    hits = own[worth[own] > 0]
                    z = weights[0] + weights[1] * worth[hits].sum() + weights[2] * math.log1p(len(own))
                    z = min(30.0, max(-30.0, z)) if len(hits) else min(NOTHING, max(-30.0, z))
                    values.append(1 / (1 + math.exp(-z)))
                    found.append([words[k] for k in hits])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(values, pa.float64()), pa.array([int(v >= CUT) for v in values], pa.int32()), pa.array(found, pa.list_(pa.string()))],
                    names=["row", "score", "predicted", "found"],
                )

    return rows.mapInArrow(run, layout)

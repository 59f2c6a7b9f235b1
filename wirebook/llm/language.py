"""Language of texts: script ranges, word scores and Viterbi with a switching penalty.

A word's script leaves the languages that are written in it.  Each word has a
log-likelihood per language from hashed byte n-grams; the best path through a
text pays a penalty wherever the language changes, which cuts mixed texts into
spans.  The language with most letters wins; its share of letters is the score.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook.llm.words import slices, split

ORDER, BUCKETS, SCALE = 4, 1 << 16, 1 << 10
SMOOTHING = 0.5
#: Cost of a change of language, in nats; least share of a language's letters for a script to be one of its own.
PENALTY, OWN_SCRIPT = 12.0, 0.01
SLICE = 8 << 20
UNKNOWN = "und"
BLANK = " \t\n\v\f\r"
WORD = re.compile(f"[^{BLANK}]+")
SPANS = "spans array<struct<start:bigint,end:bigint,lang:string,letters:bigint>>"

#: First code points of script ranges (fixed values of Unicode); letters between belong to the range before.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x2E80, "Han"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "other"),
    (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD800, "other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x20000, "Han"), (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are letters; starts and numbers of the script ranges."""
    letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool)
    return letters, np.array([a for a, _ in SCRIPTS]), np.array([NAMES.index(n) for _, n in SCRIPTS])


def _scripts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each word, and the script of its first letter (-1: none)."""
    letters, starts, numbers = _tables()
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    real = letters[code]
    count = np.bincount(word[real], minlength=len(words))
    script = np.full(len(words), -1)
    first_word, at = np.unique(word[real], return_index=True)
    script[first_word] = numbers[np.searchsorted(starts, code[real][at], side="right") - 1]
    return count, script


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's byte n-grams of orders 1 to ``ORDER``, edges marked, and the word of each."""
    raw = [b" %b " % w.encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    word = np.repeat(np.arange(len(raw)), sizes)
    buckets, owners = [], []
    code = np.zeros(len(data), np.uint32)
    for order in range(1, min(ORDER, len(data)) + 1):
        code = (code[: len(data) - order + 1] << np.uint32(8)) | data[order - 1 :]
        inside = word[: len(code)] == word[order - 1 :]
        mixed = (code[inside] ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
        buckets.append((mixed >> np.uint32(16)).astype(np.int64))
        owners.append(word[: len(code)][inside])
    return np.concatenate([np.zeros(0, np.int64), *buckets]), np.concatenate([np.zeros(0, np.int64), *owners])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, feature, n: n-gram counts, and letters by script from feature ``BUCKETS`` on.

    All rows given are counted; rows without a language or a text add nothing.
    Each task adds up its rows before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, part in slices(batch.column(0), SLICE):
                names = batch.column(1).slice(at, len(part)).dictionary_encode()
                which = names.indices.to_numpy()
                bounds, codes, words = split(pc.utf8_lower(part))
                if not words:
                    continue
                letters, script = _scripts(words)
                bucket, owner = _grams(words)
                of_word = np.repeat(which, np.diff(bounds))
                for k, name in enumerate(names.dictionary.to_pylist()):
                    times = np.bincount(codes[of_word == k], minlength=len(words)) * (letters > 0)
                    total = totals.setdefault(name, np.zeros(BUCKETS + len(NAMES)))
                    total[:BUCKETS] += np.bincount(bucket, times[owner], BUCKETS)
                    known = script >= 0
                    total[BUCKETS:] += np.bincount(script[known], (times * letters)[known], len(NAMES))
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(used), pa.string()),
                    pa.array(used.astype(np.int32)),
                    pa.array(total[used].astype(np.int64)),
                ],
                names=["lang", "feature", "n"],
            )

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = rows.mapInArrow(count, "lang string, feature int, n bigint")
    return parts.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Languages, integer word weights and the scripts each language uses."""

    def __init__(self, counts: DataFrame):
        rows = counts.toPandas()  # a row per language and feature, however many documents
        self.langs = sorted(rows["lang"].unique())
        table = np.zeros((len(self.langs), BUCKETS + len(NAMES)))
        table[rows["lang"].map(self.langs.index).astype(int), rows["feature"]] = rows["n"]
        grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
        share = (grams + SMOOTHING) / (grams.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
        self.weights = np.rint(np.log(share) * SCALE).astype(np.int64)
        self.own = scripts >= OWN_SCRIPT * np.maximum(1, scripts.sum(1, keepdims=True))
        self.own[:, ~self.own.any(0)] = True  # a script of no language leaves all of them
        self.penalty = round(PENALTY * SCALE)

    def word_scores(self, words: list[str], script: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in each language; far below for a foreign script."""
        bucket, owner = _grams(words)
        out = np.empty((len(words), len(self.langs)), np.int64)
        for k, weight in enumerate(self.weights):
            ends = np.bincount(owner, weight[bucket], len(words))
            out[:, k] = ends.astype(np.int64) - np.where(self.own[k][script], 0, 1 << 40)
        return out

    def best_path(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Language of every word; texts advance together, the longest last.

        Ties stay in the language, or go to the first in order of names.
        """
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = bounds[:-1][order], sizes[order]
        path = np.zeros(len(scores), np.int16)
        back = np.zeros(scores.shape, np.int16)
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts longer than the step
        own = np.arange(len(self.langs))
        value = np.zeros((len(sizes), len(self.langs)), np.int64)
        for t in range(steps):
            n = active[t]
            at = starts[:n] + t
            now = value[:n]
            if t:
                top = now.argmax(1)
                change = now[np.arange(n), top] - self.penalty
                moved = change[:, None] > now
                back[at] = np.where(moved, top[:, None], own)
                now = np.where(moved, change[:, None], now)
            value[:n] = now + scores[at]
        last = value.argmax(1)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            at = starts[:n] + t
            path[at] = last[:n]
            last[:n] = back[at, last[:n]] if t else last[:n]
        return path

    def spans(self, part: pa.Array) -> tuple[np.ndarray, ...]:
        """Words of each text; bounds of those with letters, their places among all, languages and letters."""
        bounds, codes, words = split(pc.utf8_lower(part))
        letters, script = _scripts(words) if words else (np.zeros(0, int), np.zeros(0, int))
        real = letters[codes] > 0
        n_words = np.diff(bounds)
        place = np.arange(len(codes)) - np.repeat(bounds[:-1], n_words)
        bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
        codes = codes[real]
        scores = self.word_scores(words, script) if words else np.zeros((0, len(self.langs)), np.int64)
        return n_words, bounds, place[real], self.best_path(scores[codes], bounds), letters[codes]

    def predict(self, part: pa.Array) -> tuple[list[str], np.ndarray, list[list[tuple]]]:
        """Language and score of each text, and its spans (start, end, lang, letters).

        A span is a run of words in one language, from its first word with
        letters to its last, in code points; the language with most letters in
        all spans is the text's.
        """
        n_words, bounds, place, path, letters = self.spans(part)
        n = len(self.langs)
        text = np.repeat(np.arange(len(part)), np.diff(bounds))
        by = np.bincount(text * n + path, letters, len(part) * n).reshape(len(part), n)
        total = by.sum(1)
        best = by.argmax(1)
        names = [self.langs[k] if t else UNKNOWN for k, t in zip(best, total, strict=True)]
        first = np.ones(len(path), bool)
        first[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(path))
        sums = np.add.reduceat(letters, begin) if len(begin) else np.zeros(0, int)
        found: list[list[tuple]] = [[] for _ in range(len(part))]
        cuts = np.searchsorted(begin, bounds)
        for i, value in enumerate(part.to_numpy(zero_copy_only=False)):
            runs = range(cuts[i], cuts[i + 1])
            if runs:
                starts, ends = _ends(value, place[begin[runs]], place[end[runs] - 1], n_words[i])
                found[i] = [(a, z, self.langs[path[begin[r]]], int(sums[r])) for a, z, r in zip(starts, ends, runs, strict=True)]
        return names, by.max(1) / np.maximum(total, 1), found


def _ends(text: str, first: np.ndarray, last: np.ndarray, n_words: int) -> tuple[list[int], list[int]]:
    """Start of some words and end of others, by their numbers in a text."""
    if len(first) == 1 and first[0] == 0 and last[0] == n_words - 1:
        return [len(text) - len(text.lstrip(BLANK))], [len(text.rstrip(BLANK))]
    places = np.array([m.span() for m in WORD.finditer(text)])
    return places[first, 0].tolist(), places[last, 1].tolist()


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows as struct ``row`` (all columns or ``keep``) with lang_pred, score and the array spans.

    A span has start and end (code points, exclusive), lang and letters, its
    number of letters; a word is what ASCII white space leaves, so a change of
    language inside one is not seen.  Only the text is looked at.  Null texts and texts without a letter are
    ``und`` with score 0, as is everything when no language was learned.
    Equal texts get equal results; an empty table gives no rows.
    """
    cast = F.col(text).cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), cast.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1), SLICE):
                names, score, spans = [UNKNOWN] * len(part), np.zeros(len(part)), [[]] * len(part)
                if shared.value.langs:
                    names, score, spans = shared.value.predict(part)
                flat = [list(c) for c in zip(*(s for own in spans for s in own), strict=True)] or [[], [], [], []]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int32)
                kinds = {"start": pa.int64(), "end": pa.int64(), "lang": pa.string(), "letters": pa.int64()}
                values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, kinds.values(), strict=True)], names=list(kinds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(names, pa.string()), pa.array(score), pa.ListArray.from_arrays(ends, values)],
                    names=["row", "lang_pred", "score", "spans"],
                )

    layout = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, {SPANS}"
    return rows.mapInArrow(run, layout)

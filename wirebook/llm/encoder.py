"""Token ids of texts by the tokenizers library, one encoding per different word.

The tokenizer drops white space and never joins pieces across it, so the ids
of a text are those of its words in order.  Each worker keeps the ids of the
words it has met; when the table is full, words met in one slice only leave.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wirebook.llm.words import slices, split

#: The file's two special tokens start so; texts with it are encoded whole.
SPECIAL = "<|"
#: ASCII marks; a run of them behind letters is a piece of its own.  Not the apostrophe, which may join them.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes columns of texts; ``max_words`` bounds the table of known words."""

    def __init__(self, path: str, max_words: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.max_words = max_words
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int32)
        self.slices = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _shrink(self) -> None:
        """Keep the words of several slices, as far as they fill half of the table."""
        names, met = list(self.known), self.slices[: len(self.known)]
        often = np.flatnonzero(met > 1)
        often = often[np.argsort(-met[often], kind="stable")[: self.max_words // 2]]
        starts, sizes, slices_ = self.starts[often], self.sizes[often].astype(np.int64), met[often] // 2
        ids = self.ids[_spread(starts, sizes)]
        self.known, self.used = {}, 0
        self._keep([names[k] for k in often], ids, sizes)
        self.slices[: len(often)] = slices_

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only, encoded as one text, and how many each has.

        Each is one piece for the tokenizer and its last token alone carries the end mark.
        """
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        found = np.array(found, np.uint32)
        ends = np.flatnonzero(self.ends[found]) + 1
        if len(ends) != len(words) or ends[-1] != len(found):
            parts = [self._whole(w) for w in words]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return found, np.diff(ends, prepend=0)

    def _add(self, words: list[str]) -> None:
        """Learn new words: letters, maybe with marks at the end, all at once; others one by one."""
        column = pa.array(words, pa.large_string())
        stems = pc.utf8_rtrim(column, characters=MARKS)
        plain = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False)
        beyond = np.flatnonzero(plain & ~pc.string_is_ascii(stems).to_numpy(zero_copy_only=False))
        plain[beyond] = [_letters(w) for w in stems.take(pa.array(beyond)).to_numpy(zero_copy_only=False)]
        rows = np.flatnonzero(plain)
        coded = stems.take(pa.array(rows)).dictionary_encode()
        which = coded.indices.to_numpy()
        flat, sizes = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # Runs of marks behind the letters.
        length = pc.utf8_length(stems).to_numpy(zero_copy_only=False)
        tails: dict[str, int] = {"": 0}
        behind = np.zeros(len(words), np.int64)
        for k in rows[(pc.utf8_length(column).to_numpy(zero_copy_only=False) > length)[rows]]:
            behind[k] = tails.setdefault(words[k][length[k] :], len(tails))
        runs = [self._whole(t) if t else np.zeros(0, np.uint32) for t in tails]
        run_sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        all_ids = np.concatenate([flat, *runs])
        starts = np.cumsum(np.concatenate((sizes, run_sizes))) - np.concatenate((sizes, run_sizes))
        parts = np.stack([which, len(sizes) + behind[rows]], 1).ravel()
        part_sizes = np.concatenate((sizes, run_sizes))[parts]
        ids = all_ids[_spread(starts[parts], part_sizes)]
        self._keep([words[k] for k in rows], ids, part_sizes.reshape(-1, 2).sum(1))
        others = [words[k] for k in np.flatnonzero(~plain)]
        found = [self._whole(w) for w in others]
        self._keep(others, np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found)))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n, total = len(self.known), len(words), len(ids)
        while first + n > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
            self.slices = np.concatenate((self.slices, np.zeros_like(self.slices)))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.slices[first : first + n] = 0
        self.ids[self.used : self.used + total] = ids
        self.used += total
        self.known.update(zip(words, range(first, first + n), strict=True))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds, codes, words = split(pc.ascii_lower(texts))
        if len(self.known) + len(words) > self.max_words and self.known:
            self._shrink()
        get = self.known.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [words[k] for k in missing]
            self._add(new)
            at[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.slices[at] += 1
        at = at[codes]
        sizes = self.sizes[at].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ends[bounds], self.ids[_spread(self.starts[at], sizes)]

    def encode(self, column: pa.Array, last: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First row, stop row, bounds of each text's ids and the ids, part by part.

        ``last`` is added to every text.
        """
        for at, part in slices(column):
            special = pc.match_substring(part, SPECIAL).to_numpy(zero_copy_only=False)
            if special.any():
                got = [self._whole(t) if s else self._one(t) for t, s in zip(part.to_pylist(), special, strict=True)]
                ends = np.concatenate(([0], np.cumsum([len(g) for g in got])))
                flat = np.concatenate(got)
            else:
                ends, flat = self._slice(part)
            bounds = ends + np.arange(len(ends))
            ids = np.empty(int(bounds[-1]), np.uint32)
            own = np.ones(len(ids), bool)
            own[bounds[1:] - 1] = False
            ids[own], ids[~own] = flat, last
            yield at, at + len(part), bounds, ids

    def _one(self, text: str) -> np.ndarray:
        return self._slice(pa.array([text], pa.large_string()))[1]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _letters(stem: str) -> bool:
    """Whether a word is letters only, and stays so as the tokenizer normalizes it."""
    return stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; its table of words outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

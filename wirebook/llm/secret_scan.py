"""Secrets in texts: fixed patterns, and random strings by token efficiency.

A random string takes many tokens of a vocabulary learned from prose: few
characters for each token.  Runs of key characters are measured so, as a whole,
in the parts between separators and in every stretch of tokens, after known
digests and identifiers are set aside.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.llm.words import slices

#: Fixed patterns.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: A text without a match of this has no span of any kind.
ANY = r"(?i)passw|secret|token|api_?key|AKIA|[0-9a-z+/_=-]{20}"

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KNOWN = [
    re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"),
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9+/_=-]+([TZ][0-9+/_=-]*){0,2}"),  # numbers, dates, times, rules
    # A digest behind its name, in hexadecimal or base64.
    re.compile("|".join(
        f"{n}[-_=]?([0-9a-f]{{{bits // 4}}}|[a-z0-9+/]{{{-(-bits // 6)}}}={{0,2}})" for n, bits in
         {"md5": 128, "sha1": 160, "sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}.items()), re.IGNORECASE),
]
#: What is set aside inside a run, between other characters than letters and digits.
ASIDE = re.compile(
    "(?<![A-Za-z0-9])(" + "|".join(f"({k.pattern})" for k in (KNOWN[1], KNOWN[0])) + "|(?i:" + KNOWN[3].pattern + ")"
    + "|[0-9][0-9+/_=-]{4,}[0-9])(?![A-Za-z0-9])"
)
PART_OF_RUN = re.compile("[A-Za-z0-9+]+")
CAPITALS = re.compile("(?<![A-Za-z0-9])[A-Z]+(?![A-Za-z0-9])")
#: Fewest characters that are judged.
LEAST = 20
#: Fewest characters for each token that count as prose.
RATIO = 2.0
#: A run is measured in parts of this length, all of them.
PART = 1000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(run: str, path: str) -> list[int]:
    """Characters of each token."""
    encoding = _encoding(path)
    tokens = (t for i in range(0, len(run), PART) for t in encoding.encode_ordinary(run[i : i + PART]))
    return [len(encoding.decode_single_token_bytes(t)) for t in tokens]


def _plain(run: str) -> str:
    """Words in capitals as small letters: one case tells nothing, and prose is learned in small letters."""
    return CAPITALS.sub(lambda m: m[0].lower(), run)


def _letters(run: str) -> bool:
    """Not numbers and separators alone."""
    return re.search("[A-Za-z]", run) is not None


def _low(run: str, path: str, ratio: float) -> Iterator[tuple[int, int]]:
    """Every shortest stretch of tokens of ``LEAST`` characters, from each token on, that costs too many.

    Tokens of separators only count on neither side: names of many short words have them.
    """
    ends = [0, *itertools.accumulate(_sizes(run, path))]
    scores = [0.0 if not run[a:b].strip("=/-_") else ratio - (b - a) for a, b in itertools.pairwise(ends)]
    scores = [0.0, *itertools.accumulate(scores)]
    j = 0
    for i, start in enumerate(ends):
        while j < len(ends) and ends[j] - start < LEAST:
            j += 1
        if j == len(ends):
            return
        if scores[j] > scores[i] and _letters(run[start : ends[j]]):
            yield start, ends[j]


def _random(run: str, path: str, ratio: float) -> list[tuple[int, int]]:
    """Places in a run that cost too many tokens: the run, or the parts where a stretch or a part does."""
    if not _letters(run) or any(k.fullmatch(run) for k in KNOWN):
        return []
    mixed = re.search("[0-9]", run) or len(re.findall("[a-z][A-Z]", run)) > 1
    if len(run) < ratio * len(_sizes(run if mixed else _plain(run), path)):
        return [(0, len(run))]
    found, at = [], 0
    for aside in [*ASIDE.finditer(run), None]:
        piece, base = run[at : aside.start() if aside else len(run)], at
        at = aside.end() if aside else len(run)
        if len(piece) < LEAST:
            continue
        piece = _plain(piece)
        low = list(_low(piece, path, ratio))
        for m in PART_OF_RUN.finditer(piece):
            if len(m[0]) >= LEAST and _letters(m[0]) and len(m[0]) < ratio * len(_sizes(m[0], path)):
                low.append(m.span())
        # Up to the next separators, so that no end of a secret stays.
        cuts = [-1, *(i for i, c in enumerate(piece) if c in "=/-_"), len(piece)]
        whole = [(cuts[bisect.bisect(cuts, a) - 1] + 1, cuts[bisect.bisect_left(cuts, b - 1)]) for a, b in _joined(low)]
        found += [(base + a, base + b) for a, b in _joined(whole)]
    return found


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str, path: str, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, number in ``KINDS``, end) in code points, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(m.start() + a, 3, m.start() + b) for m in RUN.finditer(text) for a, b in _random(m[0], path, ratio)]
    return sorted(found)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_spans(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    vocabulary: str | None = None,
    ratio: float = RATIO,
    mark: str = "[secret]",
) -> DataFrame:
    """Rows as struct ``row`` (all columns or ``keep``) with what was found.

    Adds n_assign, n_access, n_hex, base_sha256, spans (all kinds) and clean:
    the text with every span replaced by ``mark``, null if nothing was found.
    Null and empty texts have no spans.  Rows that repeat stay; an empty table
    gives no rows.  Whole texts are scanned, whatever their length.
    """
    path = vocabulary or default_vocabulary()
    cast = F.col(text).cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), cast.alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1)):
                maybe = pc.match_substring_regex(part, ANY).to_numpy(zero_copy_only=False)
                counts = [[0] * len(part) for _ in range(3)]
                base, spans, clean = [hashlib.sha256(b"").hexdigest()] * len(part), [""] * len(part), [None] * len(part)
                for i in maybe.nonzero()[0]:
                    value = part[int(i)].as_py()
                    if found := scan(value, path, ratio):
                        ours = [s for s in found if s[1] < 3]
                        for k in range(3):
                            counts[k][i] = sum(s[1] == k for s in ours)
                        base[i] = hashlib.sha256(digest(ours).encode()).hexdigest()
                        spans[i], clean[i] = digest(found), redact(value, found, mark)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)),
                        *(pa.array(c, pa.int64()) for c in counts),
                        *(pa.array(c, pa.string()) for c in (base, spans, clean)),
                    ],
                    names=["row", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean"],
                )

    out = f"row {row_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, clean string"
    return rows.mapInArrow(run, out)

import math
import random
import re
from collections import Counter

from tests.llm.conftest import odd_texts
from wirebook.llm import quality

LABELS = "doc_id long, quality int"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def bucket(gram):
    code = int.from_bytes(gram, "big")
    return ((code * 0x9E3779B1) & 0xFFFFFFFF) >> 16


def scores(texts, good):
    grams = [[bucket(b[i : i + 3]) for i in range(len(b) - 2)] for _, t in texts for b in [(t or "").encode()]]
    raw, target = Counter(), Counter()
    for (i, _), g in zip(texts, grams, strict=True):
        raw.update(g)
        if i in good:
            target.update(g)
    n = [sum(c.values()) + quality.SMOOTHING * quality.BUCKETS for c in (target, raw)]
    one = lambda b: math.log((target[b] + 1) / n[0]) - math.log((raw[b] + 1) / n[1])
    return [sum(map(one, g)) / len(g) if g else None for g in grams]


def texts():
    random.seed(8)
    plain = [a + b for a in "river hill road tree stone house field cloud".split() for b in ("", "s", "side", "ward", "ly")]
    clean = lambda: " ".join(random.choice(plain) for _ in range(900))
    out = odd_texts() + [(20 + i, clean() + "\nline\nline\n \n \n") for i in range(10)]
    junk = [(40 + i, " ".join(f"w{i}{j}%%% | $$$x{j * i}" for j in range(60))) for i in range(5)]
    return out + junk + [(60, "same again and " * 40), (61, "ab")]


def test_against_brute_force(spark, docs):
    labels = spark.createDataFrame([*((i, 1) for i in range(20, 28)), (40, 0), (41, 0), (999, 1), (None, 1), (29, None)], LABELS)
    got = quality.quality(docs(*texts()), labels).collect()
    expected = {}
    rows = texts()
    for (i, t), score in zip(rows, scores(rows, set(range(20, 28))), strict=True):
        expected[i] = (*base(t), score)
    assert len(got) == len(texts())
    for r in got:
        *counts, failed, score = expected[r.row.doc_id]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts
        assert r.base_failed == failed
        assert (r.llr is None) == (score is None) and (score is None or abs(r.llr - score) < 1e-5)
        assert r.kept == (not failed and (score is None or score >= quality.THRESHOLD))
    kept = {r.row.doc_id for r in got if r.kept}
    assert kept >= set(range(20, 30)) and not kept & {60, *range(40, 45)}


def test_without_labels_or_documents(spark, docs):
    labels = spark.createDataFrame([], LABELS)
    assert all(r.kept != r.base_failed for r in quality.quality(docs(*texts()), labels).collect())
    assert quality.quality(docs((1, "a")).where("false"), labels).collect() == []

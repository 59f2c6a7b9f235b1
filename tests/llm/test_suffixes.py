import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import odd_texts
from wirebook.llm import suffixes


def brute(texts, length):
    raws = [(t or "").encode() for _, t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(texts, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts():
    random.seed(12)
    word = lambda n: " ".join(random.choice(["alpha", "be", "ça", "delta", "e"]) + str(random.randint(0, 99)) for _ in range(n))
    passages = [word(n) for n in (30, 40, 41, 80)]
    out = [(i, word(random.randint(0, 60)) + random.choice(passages) + word(random.randint(0, 60))) for i in range(40)]
    long = word(300)
    out += [(50 + i, long[: 900 + i] + "!" + long[900 + i :]) for i in range(12)]
    out += [(70, "ab" * 500), (71, "ab" * 400 + "c" + "ab" * 300), (72, "z" * 199), (73, "z" * 201), (74, "y" * 200), (75, "y" * 200)]
    return out + [(80, passages[0][:199]), (81, passages[0][:200])]


def run(table, **options):
    return sorted((tuple(r) for r in suffixes.repeated_bytes(table, **options).collect()), key=repr)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_against_all_strings(docs, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BATCH", 40)
    rows = texts() + [(None if i is None else i + 1000, t) for i, t in odd_texts()]
    assert run(docs(*rows)) == brute(rows, 200)


def test_more_tasks_than_partitions(docs, monkeypatch):
    """Tasks follow the number of anchors, not the session's setting."""
    used = []
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "PART_ANCHORS", 50)
    monkeypatch.setattr(suffixes, "PART_SUFFIXES", 30)
    monkeypatch.setattr(suffixes, "_merged", lambda sent, parts, length, real=suffixes._merged: used.append(parts) or real(sent, parts, length))
    rows = texts()
    assert run(docs(*rows)) == brute(rows, 200)
    assert used[0] > 8


def test_short_strings_and_kept_bytes(docs):
    rows = [(1, "abcdefgh-abcdefgh"), (2, "xxabcdefghyy"), (3, "unlike"), (4, None)]
    got = {r.doc_id: r for r in suffixes.repeated_bytes(docs(*rows), length=8, gram=4, with_text=True).collect()}
    assert [tuple(got[d])[:5] for d in sorted(got)] == brute(rows, 8)
    assert (got[1].kept, got[2].kept, got[4].kept) == (b"-", b"xxyy", b"")


def test_no_documents(docs):
    assert run(docs((1, "a")).where("false")) == []


def test_merge_of_front_coded_runs():
    random.seed(6)
    lists = []
    for _ in range(7):
        n = random.randint(0, 40)
        lists.append(sorted("".join(random.choice("ab") for _ in range(random.randint(1, 12))).encode() for _ in range(n)))
    runs = []
    for values in lists:
        size = np.array([len(v) for v in values], np.int64)
        right = np.zeros((len(values), 12), np.uint8)
        for row, v in zip(right, values, strict=True):
            row[: len(v)] = list(v)
        zero = np.zeros(len(values), np.int64)
        runs.append(suffixes.decode_run(suffixes.encode_run(np.arange(len(values)), zero, zero, right, size, np.zeros((len(values), 0), np.uint8))))
    got = list(suffixes.merge(runs))
    assert [v for _, _, v, _ in got] == sorted(v for values in lists for v in values)
    assert all(lists[k][i] == v for k, i, v, _ in got)
    for (_, _, a, _), (_, _, b, common) in zip(got, got[1:], strict=False):
        assert common == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_a_task_holds_a_bounded_share():
    """An executor went over 3,000 MB with blocks of 4 MiB and 150,000 suffixes in a task."""
    assert suffixes.BLOCK_BYTES <= 2 << 20 and suffixes.PART_SUFFIXES <= 75_000

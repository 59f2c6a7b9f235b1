import zlib
from collections import defaultdict

from tests.llm.conftest import odd_texts
from wirebook.llm.sharding import shard_by_bytes


def check(rows, texts, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (repr(i), size(t), zlib.crc32((t or "").encode())) for i, t in texts
    )
    slots, home = defaultdict(list), defaultdict(set)
    text_of = {i: t for i, t in texts}
    for r in rows:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        home[text_of[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in home.values())


def test_odd_rows(docs):
    check(shard_by_bytes(docs(*odd_texts()), 4).collect(), odd_texts(), 4)


def test_balance_and_order(docs):
    texts = [(i, f"text number {i // 2} " * (i % 7 + 1)) for i in range(500)]
    rows = shard_by_bytes(docs(*texts), 8).collect()
    check(rows, texts, 8)
    total, by = sum(r.size for r in rows), defaultdict(int)
    for r in rows:
        by[r.shard] += r.size
    assert max(by.values()) - min(by.values()) <= 600 and sum(by.values()) == total
    shards = [r.shard for r in sorted(rows, key=lambda r: r.doc_id)]
    firsts = [s for i, s in enumerate(shards) if texts[i][1] not in {t for _, t in texts[:i]}]
    assert firsts == sorted(firsts)


def test_nothing_and_one(docs):
    assert shard_by_bytes(docs((1, "a")).where("false")).collect() == []
    assert [r.slot for r in shard_by_bytes(docs((1, "a"))).collect()] == [0]

import hashlib
import random
import re

import pytest

from tests.llm.conftest import odd_texts
from wirebook.llm.decontaminate import contamination


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items):
    out = []
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    for i, text in texts:
        w = words(text)
        hit, ids = set(), set()
        for n in range(1, 11):
            for p in range(len(w) - n + 1):
                if found := wanted.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    ids |= found
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=repr)


def run(docs, items, **options):
    rows = contamination(docs, items, **options)
    rows = rows.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "broadcast_hashes": 0}])
def test_against_brute_force(spark, docs, limits):
    """With all fingerprints sent, with their hashes sent, and with a shuffle."""
    random.seed(7)
    vocabulary = ["a", "b", "Über", "7"]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(10, text(30)), (11, text(11)), (12, text(10)), (13, text(4) + " zz"), (13, text(9)), (14, "!!"), (15, None)]
    items += [(16, "q " * 14), (None, "lone"), (10, text(12))]
    texts = [(i, text(random.choice([0, 3, 9, 10, 40, 200]))) for i in range(25)]
    texts += [(i + 100, text(5) + ", " + items[i % 3][1].upper().replace("Ü", "ü") + "! " + text(8)) for i in range(6)]
    texts += [(200, "Q-" * 40), (201, "a q Q q b"), (202, "Lone."), (100, texts[-6][1])] + odd_texts()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert run(docs(*texts), table, **limits) == brute(texts, items)


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert run(docs((1, "x")).where("false"), items) == []
    assert run(docs((1, "a b c")), items.where("false")) == brute([(1, "a b c")], [])


def test_keeps_all_columns(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    row = contamination(docs((1, "a b c")), items).select("row.*", "contaminated").first()
    assert row.row == "r" and row.words == "w" and row.contaminated

import random

import numpy as np
import zstandard

from tests.llm.conftest import odd_texts
from wirebook.llm import language, toxicity

PLAIN = [a + b for a in "river hill road tree stone house field cloud meadow valley".split() for b in ("", "s", "side", "ward", "ly", "ing", "er")]
BAD = "grobnak vexulor skrimwit thornpest".split()
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=400, seed=4):
    """(doc_id, text) and the ids of those with bad words, one in eight, some of them copies of each other."""
    rng = random.Random(seed)
    rows, bad = [], set()
    for i in range(n):
        words = rng.choices(PLAIN, k=rng.randint(20, 200))
        if i % 8 == 0:
            bad.add(i)
            for _ in range(max(2, len(words) // 50)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "###"]))
        rows.append((i, " ".join(words)))
    copied = next(t for i, t in rows if i in bad)
    return rows + [(n + k, copied + " Copy%d" % k) for k in range(20)], bad | {n + k for k in range(20)}


def labels(spark, rows, bad):
    return spark.createDataFrame([(i, 1, int(i in bad), "t") for i, _ in rows] + [(None, 1, 1, "t"), (1, 1, None, "t"), (9999, 1, 1, "t")], LABELS)


def test_held_out_documents(spark, docs):
    rows, bad = corpus()
    table = docs(*rows)
    chosen = toxicity.sample(table, labels(spark, rows, bad))
    held = {r.doc_id for r in table.where(language.held_out(table.doc_id)).collect()}
    texts = dict(rows)
    assert 90 < len(held) < 130 and not {texts[i] for i in held} & set(chosen["text"])
    model = toxicity.train(chosen)
    got = {r.row.doc_id: r for r in toxicity.score(table, model).collect()}
    assert len(got) == len(rows)
    hits = np.mean([got[i].predicted for i in held & bad])
    wrong = np.mean([got[i].predicted for i in held - bad])
    assert hits > 0.95 and wrong < 0.02
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert all(any(w.startswith(b) for b in BAD) for i in held & bad for w in got[i].found)
    assert got[3].row.row == "r"


def test_odd_texts_are_not_toxic(spark, docs):
    rows, bad = corpus()
    model = toxicity.train(toxicity.sample(docs(*rows), labels(spark, rows, bad)))
    odd = [*odd_texts(), (30, "z" * 3_000_000), (31, "meadow " * 400_000), (32, "Grobnak! " * 300 + "VEXULOR")]
    got = toxicity.score(docs(*odd), model).collect()
    assert len(got) == len(odd)
    assert {r.row.doc_id for r in got if r.predicted} == {32}
    assert toxicity.score(docs((1, "a")).where("false"), model).collect() == []


def test_without_both_classes(spark, docs):
    rows, _ = corpus(20)
    assert toxicity.train(toxicity.sample(docs(*rows), labels(spark, rows, set()))) is None
    assert toxicity.train(toxicity.sample(docs(*rows).where("false"), labels(spark, rows, set()))) is None
    assert {(r.score, r.predicted) for r in toxicity.score(docs(*rows), None).collect()} == {(0.0, 0)}


def test_sample_is_bounded_and_whole(spark, docs):
    rows, bad = corpus()
    table = docs(*rows, *rows[:50], (None, "no id"))  # ids that repeat
    found = toxicity.sample(table, labels(spark, rows, bad), size=10)
    assert sorted(found["toxic"]) == [0] * 10 + [1] * 10
    assert set(found["text"]) <= {t for _, t in rows}
    long = docs((0, "x " * 20_000), (8, "y"))
    assert list(toxicity.sample(long, labels(spark, rows, bad))["text"]) == ["y"]


def test_cells_are_lengths_under_the_two_dictionaries():
    by = toxicity.Compressor(b" grobnak vexulor ", b" meadow valley hillside ")

    def length(content, word):
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        one = zstandard.ZstdCompressor(dict_data=given, level=toxicity.LEVEL)
        return len(one.compress(toxicity.PAD + b" " + word + b" " + toxicity.PAD))

    assert by.cells(b"grobnak")[0] // toxicity.LEFT >= 3 and length(b" grobnak vexulor ", b"grobnak") < length(b" meadow valley ", b"grobnak")
    assert by.cells(b"meadow")[0] // toxicity.LEFT == 0
    long = b"a" * 40 + b"grobnak" + b"b" * 60
    assert max(c // toxicity.LEFT for c in by.cells(long)) >= 2

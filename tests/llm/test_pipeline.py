import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontaminate, test_jaccard, test_quality
from tests.llm.conftest import odd_texts
from tests.llm.test_tokens import crc
from wirebook.llm import quality, secret_scan
from wirebook.llm.encoder import default_tokenizer

random.seed(21)
NOUNS = [a + b for a in "river hill road tree stone house field cloud".split() for b in ("", "s", "side", "ward", "ly")]


def prose(n):
    return " ".join(random.choice(NOUNS) for _ in range(n)) + ". "


def corpus():
    items = [(i, prose(14)) for i in range(4)] + [(None, None), (9, "")]
    base = [prose(random.randint(200, 900)) for _ in range(12)]
    texts = list(enumerate(base))
    texts += [(100 + i, t[: len(t) // 2] + "changed " + t[len(t) // 2 :]) for i, t in enumerate(base[:5])]
    texts += [(200 + i, prose(120) + items[i][1] + prose(100)) for i in range(3)]
    texts += [(300 + i, prose(150) + f'token = "{random.randbytes(20).hex()}" ' + prose(80)) for i in range(3)]
    texts += [(400 + i, " ".join(f"w{i}{j}%%% | $$$x{j * i}" for j in range(90))) for i in range(4)]
    texts += [(500, base[0]), (501, prose(3000))] + [(600 + (i or 0), t) for i, t in odd_texts()]
    return texts, items, [(i, 1) for i in range(12)] + [(400, 0)]


def plain(texts, items, labels):
    """The pipeline's stages by hand: what is left to pack."""
    good = {i for i, q in labels if q == 1}
    scores = test_quality.scores(texts, good)
    left = [
        (i, t)
        for (i, t), s in zip(texts, scores, strict=True)
        if not test_quality.base(t)[-1] and (s is None or s >= quality.THRESHOLD)
    ]
    first = {i for i, n, c in test_jaccard.brute(left) if i == c}
    left = [(i, t) for i, t in left if i in first]
    dirty = {r[0] for r in test_decontaminate.brute(left, items) if r[5]}
    left = [(i, t) for i, t in left if i not in dirty]
    path = secret_scan.default_vocabulary()
    return [(i, secret_scan.redact(t, secret_scan.scan(t, path), "[secret]")) for i, t in left]


@pytest.fixture
def folder(spark, docs, tmp_path):
    texts, items, labels = corpus()
    docs(*texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_against_plain_stages(spark, folder):
    texts, items, labels = corpus_of(spark, folder)
    tokenizer = Tokenizer.from_file(default_tokenizer())
    expected = []
    left = plain(texts, items, labels)
    for i, t in left:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        expected += [(i, p // 2048, p, len(ids[p : p + 2048]), crc(ids[p : p + 2048])) for p in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    kept = {i for i, _ in left}
    assert kept >= {0, 5, 11, 300, 301, 302, 501} and not kept & {100, 200, 201, 202, 400, 500}
    assert all("[secret]" in t for i, t in left if 300 <= i < 303)


def test_near_duplicates_with_repeated_and_null_ids(spark, docs, folder):
    """One row of each component, whichever rows share an id or have none."""
    a, b, c, d = (prose(200) for _ in range(4))
    near = a[: len(a) // 2] + "changed " + a[len(a) // 2 :]
    rows = [(3, a), (7, near), (7, b), (7, b), (None, b), (None, c), (None, c), (None, c + "end."), (8, c), (9, d), (9, d), (None, prose(200)), (None, "one two"), (4, None), (4, ""), (None, " ")]
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    table = docs(*rows)
    got = [(r.doc_id, r.text) for r in stage(spark, table, folder).collect()]
    left = [t for _, t in got]
    assert stage(spark, table, folder).columns == table.columns
    assert sorted(left, key=repr) == sorted([a, b, left[left.index(c)], d, rows[11][1], "one two", None, "", " "], key=repr)
    assert (3, a) in got and (7, b) in got and (8, c) in got and (9, d) in got


def corpus_of(spark, folder):
    """The corpus as it was written."""
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]
    return read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"), read("labels", "doc_id", "quality")


def test_stages_keep_the_columns(spark, docs, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, folder)
        assert out.columns == table.columns and out.count() > 0
        assert stage(spark, table.where("false"), folder).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, table.where("false"), folder).collect() == []

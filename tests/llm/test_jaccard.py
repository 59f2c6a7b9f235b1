import random
import re

import numpy as np
import pytest

from tests.llm.conftest import odd_texts
from wirebook.llm import jaccard
from wirebook.llm.components import components


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(texts):
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        ids = least.setdefault(find(i), [])
        if d is not None:
            ids.append(d)
    return sorted(((d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(texts)), key=repr)


def edited(words, changes):
    words = list(words)
    for _ in range(changes):
        words[random.randrange(len(words))] = f"new{random.random()}"
    return " ".join(words)


def families():
    random.seed(9)
    texts = []
    for f in range(6):
        base = [f"w{random.randint(0, 400)}" for _ in range(random.choice([6, 60, 150, 400]))]
        texts += [edited(base, random.randint(0, 1 + len(base) // 30)) for _ in range(12)]
        grown = list(base)
        for _ in range(6):  # a chain whose ends are not similar
            grown = grown[len(grown) // 10 :] + [f"g{random.random()}" for _ in range(len(grown) // 10)]
            texts.append(" ".join(grown))
    common = " ".join(f"c{i}" for i in range(60))
    texts += [common + " " + " ".join(f"u{i}-{j}" for j in range(random.choice([3, 10, 12, 20, 60]))) for i in range(30)]
    random.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def run(table):
    return sorted((tuple(r) for r in jaccard.near_duplicates(table).drop("sig", "label").collect()), key=repr)


def test_families_and_odd_rows(docs):
    odd = [(None if i is None else i + 1000, t) for i, t in odd_texts()]
    texts = families() + odd + [(2000, "A b C d"), (2001, "a  B\tc d"), (3, families()[5][1]), (None, families()[7][1])]
    assert run(docs(*texts)) == brute(texts)


def test_families_in_pieces(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE_SETS", 4)
    texts = families()
    assert run(docs(*texts)) == brute(texts)


def test_no_documents(docs):
    assert run(docs((1, "a")).where("false")) == []
    assert run(docs((1, None), (2, ""))) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("seed", range(5))
def test_resolve_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 30)).astype(np.uint64)) for _ in range(60)]
    base = np.arange(100, 140, dtype=np.uint64)
    sets += [np.unique(np.concatenate((rng.choice(base, 36, False), rng.integers(0, 50, 2).astype(np.uint64)))) for _ in range(60)]
    found = jaccard.resolve(sets)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            if same and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    assert all((found[i] == found[j]) == (root[i] == root[j]) for i in range(len(sets)) for j in range(i))


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299)]
    random.shuffle(edges)
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {299: 299, 300: 299}
    assert got == expected


def test_runs_are_stars():
    """Every set of a run is joined to the run's first, so a family of copies settles in few rounds."""
    n = 500
    sig = np.arange(10, 10 + n)
    a, b = jaccard._edges(np.full(n, 7, np.uint64), sig, np.full(n, 100), np.zeros(n, np.int64))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(10, s) for s in sig[1:].tolist()}
    # Sizes that no link can bridge part two runs; another token joins nothing.
    size = np.array([100] * 3 + [400] * 3 + [100])
    token = np.array([7] * 6 + [8], np.uint64)
    a, b = jaccard._edges(token, np.arange(7), size, np.zeros(7, np.int64))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(0, 1), (0, 2), (3, 4), (3, 5)}


def jobs_of(spark, name, action):
    """How many jobs of Spark an action takes."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(name))


def test_a_part_sends_stars():
    """A path that comes as edges in any order leaves as one star, so that components settle in few rounds."""
    rng = np.random.default_rng(3)
    nodes = rng.permutation(500)
    turn = rng.permutation(499)
    a, b = jaccard._stars(nodes[:-1][turn], nodes[1:][turn])
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, 0) for i in range(1, 500)]
    a, b = jaccard._stars(np.array([9, 4, 4, 7]), np.array([4, 9, 5, 7]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(5, 4), (9, 4)]
    assert [len(x) for x in jaccard._stars(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_rounds_shuffle_little(spark):
    """A round joins each end of the edges once: jobs grow with shuffles, and each costs a task a partition."""
    table = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(3)
    assert jobs_of(spark, "rounds", lambda: components(table).collect()) <= 72


def test_pieces_take_few_jobs(spark, docs, monkeypatch):
    """What is found inside the pieces is stored once and not compared again."""
    monkeypatch.setattr(jaccard, "PIECE_SETS", 4)
    table = docs(*families())
    assert jobs_of(spark, "pieces", lambda: jaccard.near_duplicates(table).collect()) <= 150


def test_parity_bits_part_no_similar_sets():
    """Bits of two sets, at any of their widths, differ in no more places than tokens; random sets of a size are told apart."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 700, np.uint64)
    sets = [np.unique(base[: int(k)]) for k in rng.integers(5, 700, 80)]
    sets += [np.unique(np.concatenate((base[:400], rng.integers(0, 2**64, 40, np.uint64)))) for _ in range(20)]
    sets += [np.unique(rng.integers(0, 2**64, 500, np.uint64)) for _ in range(100)]
    numbers, n = np.arange(len(sets)), np.array([len(s) for s in sets])
    bits = [np.frombuffer(b, "<u8") for b in jaccard._parities(sets)]
    a, b = jaccard._close(numbers, n, bits, [numbers])
    root = numbers.copy()
    root[a] = b
    for i in numbers:
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * same < 80 * (n[i] + n[j] - same) or root[i] == root[j]
    assert not set(a.tolist()) & set(range(100, 200))


def test_shared_phrases_chain_nothing(spark, docs, monkeypatch, tmp_path):
    """Texts that share a passage with some others, and no more, are not brought together; before, they were one family."""
    passages = {(i, k): [f"p{i}-{k}-{j}" for j in range(60)] for i in range(60) for k in (1, 7, 13)}
    texts = []
    for i in range(60):
        own = [x for k in (1, 7, 13) for x in (*passages[i, k], *passages[(i - k) % 60, k])]
        texts.append((i, " ".join(own)))
    texts += [(100, texts[5][1]), (101, texts[9][1] + " end")]
    monkeypatch.setattr(jaccard, "shared_dir", lambda _: str(tmp_path))
    assert run(docs(*texts)) == brute(texts)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 2


def test_ids_are_looked_up(spark):
    """No id of the table is missed, null too, and few others are found."""
    ids = spark.createDataFrame([(i * 7919,) for i in range(500)] + [(None,), (-(2**63),)], "k long")
    others = spark.createDataFrame([(i * 7919 + 1,) for i in range(5000)], "k long")
    test = jaccard._among(ids, "k")
    assert ids.where(~test(ids.k)).count() == 0
    assert others.where(test(others.k)).count() <= 5
    empty = jaccard._among(ids.where("false"), "k")
    assert ids.where(empty(ids.k)).count() == 0


def test_rows_alone_are_not_shuffled(docs):
    """Rows that stay for certain meet no join; copies, repeated ids and rows without an id are decided as before."""
    words = [" ".join(f"w{i}-{j}" for j in range(20)) for i in range(8)]
    texts = [(i, t) for i, t in enumerate(words)] + [(20, words[2]), (3, "other text of five words"), (None, words[5]), (None, "no id but words here"), (21, "")]
    out = jaccard.one_of_each(docs(*texts))
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert kept == sorted([*enumerate(words), (3, "other text of five words"), (None, "no id but words here"), (21, "")], key=repr)
    assert "Join" not in out._jdf.queryExecution().sparkPlan().children().apply(0).toString()

import math
import random

import numpy as np
import pytest

from wirebook.llm import queries, whitening

ROWS = "vec_id long, embedding array<float>, label int, row string, x int, n int, whitened string, deviation int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "r", 1, 2, "w", 3) for i, v in rows], ROWS).repartition(3)


def expected(vectors, want=4):
    """Fit list, count, sums, eigenvalues and eigenvectors by numpy."""
    x = np.floor(np.array(vectors, np.float32).astype(float) * 256).astype(np.int64)
    different = np.unique(x, axis=0)
    n, sums = len(different), different.sum(0)
    centred = different - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    turn = np.argsort(-values)[:want]
    return x, n, sums, values[turn], vectors[:, turn], values.sum()


def vectors(n, size, seed=3):
    rng = np.random.default_rng(seed)
    scale = np.linspace(2, 0.2, size)
    return (rng.standard_normal((n, size)) @ np.linalg.qr(rng.standard_normal((size, size)))[0] * scale).astype(np.float32).tolist()


@pytest.mark.parametrize("size", [7, 2])
def test_against_numpy(spark, size):
    good = vectors(300, size)
    good += [good[0]] * 200 + [[v + 1e-7 for v in good[1]]]  # rows that repeat, and one in the same steps
    odd = [None, [], [None] * size, [1.0] * (size + 1), [math.nan] + [1.0] * (size - 1), [-math.inf] * size]
    rows = table(spark, list(enumerate(good)) + [(None, good[5])] + [(1000 + i, v) for i, v in enumerate(odd)])
    x, n, sums, values, axes, total = expected(good)
    model = whitening.fit(rows)
    assert (model.n, model.sums) == (n, sums.tolist())
    assert np.allclose(model.values, values, rtol=1e-12) and math.isclose(model.total, total, rel_tol=1e-12)
    assert np.allclose(np.abs((model.vectors * axes).sum(0)), 1, atol=1e-12)
    assert model.identity_error < 1e-12
    got = whitening.whiten(rows, model).collect()
    assert len(got) == len(good) + 1
    sign = np.sign((model.vectors * axes).sum(0))
    white = (x - sums / n) @ axes / np.sqrt(values) * sign
    for r in got:
        i = 5 if r.row.vec_id is None else r.row.vec_id
        assert np.allclose(r.whitened, white[i], atol=1e-9)
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert r.row.whitened == "w"


def test_fewer_components_than_asked(spark):
    """A dimension without variance gives no component; neither do equal vectors."""
    flat = [[float(i), 2.0 * i, 5.0] for i in range(20)]
    model = whitening.fit(table(spark, list(enumerate(flat))))
    assert len(model.values) == 1 and math.isclose(model.values[0] / model.total, 1)
    same = table(spark, [(i, [1.0, 2.0]) for i in range(5)])
    model = whitening.fit(same)
    assert (model.n, len(model.values), model.identity_error) == (1, 0, None)
    assert [(r.deviation, r.whitened) for r in whitening.whiten(same, model).collect()] == [(0, [])] * 5


def test_no_usable_vectors(spark):
    for rows in ([], [(1, None), (2, []), (3, [math.nan])]):
        empty = table(spark, rows)
        assert whitening.fit(empty) is None
        assert whitening.whiten(empty, None).collect() == []


def test_query_over_a_table(spark, tmp_path):
    rows = vectors(50, 5)
    table(spark, list(enumerate(rows))).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_embedding_whitening(spark, str(tmp_path)).collect()
    x, n, _, values, _, total = expected(rows)
    assert sorted((r.vec_id, r.component) for r in got) == [(i, k) for i in range(50) for k in (1, 2, 3, 4)]
    for r in got:
        assert r.n == n and math.isclose(r.explained, values[r.component - 1] / total, rel_tol=1e-12) and r.identity_error < 1e-12
    table(spark, []).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.op13_embedding_whitening(spark, f"{tmp_path}/none").collect() == []


def test_large_entries_are_exact(spark):
    rows = [(i, [float(random.Random(i).randrange(-(2**60), 2**60)), 1e30 if i == 3 else 0.0]) for i in range(6)]
    steps = [[int(np.float32(a)) * 256 for a in v] for _, v in rows]
    steps = [[max(-(2**63), min(2**63 - 1, a)) for a in v] for v in steps]
    model = whitening.fit(table(spark, rows))
    assert model.sums == [sum(c) for c in zip(*set(map(tuple, steps)), strict=True)]
    assert {r.deviation for r in whitening.whiten(table(spark, rows), model).collect()} == {None}


@pytest.mark.parametrize("values", [np.array([5.0] * 20 + [1.0] * 20), np.logspace(0, -15, 40), 1 + 1e-13 * np.arange(40), np.repeat([0.0, 1.0], 20), np.zeros(40), np.array([1.0, 2, 2, 3])])
def test_spectral_components(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.spectral_components(a, 4)
    assert np.allclose(e, np.sort(values)[::-1][:4], rtol=1e-12, atol=1e-14)
    assert np.abs(v.T @ v - np.eye(4)).max() < 1e-13 and np.linalg.norm(a @ v - v * e) < 1e-13 * max(1, np.abs(values).max())

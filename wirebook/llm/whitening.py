"""Whitening of embeddings by a spectral divide-and-conquer.

Entries become integers, so that equal vectors are equal and sums are exact.
Counts, sums and the centred covariance of the different vectors are added up
by tasks; only the covariance, whose size is that of one vector squared,
reaches the driver.  There the polar factor of the covariance less a shift,
found by dynamically weighted Halley steps (QDWH), gives the projector on the
components above the shift; the invariant subspaces on both sides are split
again until each is one component.  The chosen components are sent back and
applied to every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirebook.llm.words import small_batches
from wirebook.sources.tables import shared_dir

STEPS = 256
EPS = np.finfo(float).eps
HALF = 1 << 32


class Whitening(NamedTuple):
    """A fitted model: ``vectors`` has a unit component per column, ``values`` their falling variances.

    ``n`` and ``sums`` are those of the different vectors, ``total`` is the
    trace of their covariance, and ``identity_error`` the largest difference
    of their whitened covariance, as measured, from the identity.
    """

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    total: float
    identity_error: float | None


def polar(a: np.ndarray) -> tuple[np.ndarray, bool]:
    """Orthogonal polar factor of a symmetric matrix, and whether it came out orthogonal.

    The weights of each Halley step follow from a lower bound of the least
    singular value; a step with large weights goes by QR, others by Cholesky.
    """
    m = len(a)
    one = np.eye(m)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(low, EPS))
    for _ in range(30):
        before = x
        d = np.cbrt(4 * (1 - low**2) / low**4)
        p = np.sqrt(1 + d) + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))[0]
            x = q / r * x + (p - q / r) / np.sqrt(r) * both[:m] @ both[m:].T
        else:
            half = np.linalg.inv(np.linalg.cholesky(one + r * x.T @ x))
            x = q / r * x + (p - q / r) * (x @ half.T) @ half
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if np.linalg.norm(x - before) < EPS ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x, bool(np.linalg.norm(x @ x - one) < 1e-11 * m)


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if all eigenvalues agree.

    The mean of the eigenvalues lies between the least and the largest.  If it
    meets one of them, shifts beside it are tried.
    """
    m = len(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m))
    if spread <= 4 * EPS * np.linalg.norm(a):
        return None
    for beside in (0, 0.03, -0.03, 0.11, -0.11, 0.27, -0.27):
        u, good = polar(a - (mean + beside * spread / np.sqrt(m)) * np.eye(m))
        above = (u + np.eye(m)) / 2
        rank = int(round(np.trace(above)))
        if good and 0 < rank < m:
            # A projector's range from as many fixed random directions as its rank, twice for orthogonality.
            start = np.random.default_rng(m).standard_normal((m, rank))
            basis = np.linalg.qr(above @ np.linalg.qr(above @ start)[0], mode="complete")[0]
            return basis[:, :rank], basis[:, rank:]
    return None


def spectral_components(a: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    m = len(a)
    if not want or not m:
        return np.zeros(0), np.zeros((m, 0))
    sides = _split(a) if m > 1 else None
    if sides is None:
        order = np.argsort(-np.diag(a), kind="stable")[:want]
        return np.diag(a)[order], np.eye(m)[:, order]
    values, vectors = [], []
    for side in sides:
        part = side.T @ a @ side
        e, v = spectral_components((part + part.T) / 2, want - sum(map(len, values)))
        values.append(e)
        vectors.append(side @ v)
    return np.concatenate(values), np.concatenate(vectors, axis=1)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _rows(rows: DataFrame, vector: str, keep: list[str] | None) -> DataFrame:
    """Rows with a vector of finite entries, as struct ``row``, and the vector in whole steps, ``x``."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where(F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0))
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * STEPS).cast("bigint"))
    return kept.select(F.struct(*[rows[c] for c in keep or rows.columns]).alias("row"), x.alias("x"))


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension; a row per dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = _vectors(batch.column(0), size)
            n += len(x)
            high += (x // HALF).sum(0)
            low += (x % HALF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])

    parts = fit.mapInArrow(add, "dim bigint, n bigint, high bigint, low bigint")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = parts.groupBy("dim").agg(total("n"), total("high"), total("low")).collect()
    sums = {r.dim: int(r.high) * HALF + int(r.low) for r in found}
    return (int(found[0].n) if found else 0), [sums[i] for i in range(len(sums))]


def _gram(fit: DataFrame, size: int, mean: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """Sum of the outer products of the centred vectors, or of their projections.

    Tasks add up their rows; their sums meet by matrix row.
    """
    m = size if onto is None else onto.shape[1]
    layout = "i int, sums array<double>"
    schema = pa.schema([("i", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def rows_of(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], schema.field(1).type)], schema=schema)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((m, m)), False
        for batch in batches:
            x = _vectors(batch.column(0), size) - mean
            x = x if onto is None else x @ onto
            total += x.T @ x
            any_ |= len(x) > 0
        if any_:
            yield rows_of(dict(enumerate(total)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.array(values)
        if sums:
            yield rows_of(sums)

    found = fit.mapInArrow(multiply, layout).repartition("i").mapInArrow(add, layout).collect()
    out = np.zeros((m, m))
    for r in found:
        out[r.i] = r.sums
    return (out + out.T) / 2


def fit(rows: DataFrame, *, vector: str = "embedding", components: int = 4) -> Whitening | None:
    """The largest components of the different vectors; None without usable vectors.

    Vectors of another length than the most frequent (of equals, the longest)
    are left out, as ``whiten`` does.  Components without variance are not
    components, so there may be fewer than asked for.
    """
    spark = rows.sparkSession
    small_batches(spark, rows=4000)
    x = _rows(rows, vector, [vector]).select("x")
    sizes = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return None
    size = sizes["size"]
    path = f"{shared_dir(spark)}/fit"
    x.where(F.size("x") == size).distinct().write.parquet(path)
    different = spark.read.schema(x.schema).parquet(path)
    n, sums = _sums(different, size)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    cov = _gram(different, size, mean) / n
    total = float(np.trace(cov))
    values, vectors = spectral_components(cov, components)
    real = values > size * EPS * total
    values, vectors = values[real], vectors[:, real]
    error = None
    if len(values):
        white = _gram(different, size, mean, vectors / np.sqrt(values)) / n
        error = float(np.abs(white - np.eye(len(values))).max())
    return Whitening(n, sums, mean, values, vectors, total, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - sum) ** 2 of each row, exact; null beyond 64 bits."""
    most = max(1, int(x.max(initial=0)), -int(x.min(initial=0)))
    wide = max(1, *map(abs, sums))
    exact = most * max(most, wide) * len(sums) < 1 << 62
    x = x if exact else x.astype(object)
    squares, products = (x * x).sum(1), (x * np.array(sums, dtype=np.int64 if exact else object)).sum(1)
    own = sum(s * s for s in sums)
    found = [n * n * int(q) - 2 * n * int(p) + own for q, p in zip(squares, products, strict=True)]
    return [v if v < 1 << 63 else None for v in found]


def whiten(rows: DataFrame, model: Whitening | None, *, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Rows as struct ``row`` (all columns or ``keep``), deviation and the array ``whitened``, a value per component.

    Rows whose vector is null, empty, of another length than the model's, or
    holds null or non-finite entries are dropped; rows that repeat stay.
    Entries times 256 beyond 64 bits stop at their limits.  Without a model
    there are no rows.
    """
    small_batches(rows.sparkSession, rows=4000)
    found = _rows(rows, vector, keep)
    layout = f"row {found.schema['row'].dataType.simpleString()}, deviation bigint, whitened array<double>"
    if model is None:
        return found.where("false").select("row", F.lit(0).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    size, onto = len(model.sums), model.vectors / np.sqrt(model.values)
    shared = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.mean, onto))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, onto = shared.value
        for batch in batches:
            x = _vectors(batch.column(1), size)
            white = (x - mean) @ onto
            ends = np.arange(len(x) + 1, dtype=np.int32) * onto.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(ends, white.ravel())],
                names=["row", "deviation", "whitened"],
            )

    return found.where(F.size("x") == size).mapInArrow(run, layout)

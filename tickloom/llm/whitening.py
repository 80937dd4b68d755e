"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Distinct vectors of whole numbers are written once as chunks. Each step multiplies the centred rows by a vector (Xv) and by the left vector
that results (X'u), as sums over chunks; left vectors stay implicit, as products of the rows with short vectors, so that nothing as long as the
table is kept between steps and a lost task is just run again. Left vectors are orthogonalised against all earlier ones by sums over the rows,
twice; right vectors on the driver, where they are as short as an embedding. The singular values of the small bidiagonal matrix give the
components and deviations. Where a product vanishes (repeated or missing directions), a fresh direction goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bound_batches, quoted
from tickloom.llm.topk import chunks_of, opened

#: Components larger than this, either way, count as this. What vanishes beside the largest norm. When residuals beside the largest value end the steps.
MOST, NOTHING, SETTLED = 1 << 40, 1e-12, 1e-15
LONG = (1 << 63) - 1


class Centred:
    """The rows' whole numbers times n, less their sums: exact, in longs where they fit."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.kind = n, np.int64 if n * most * 2 < 1 << 62 else object
        self.sums = np.array(sums, self.kind)

    def exact(self, m: np.ndarray) -> np.ndarray:
        return m.astype(self.kind) * self.n - self.sums

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return self.exact(m).astype(np.float64) / self.n

    def deviations(self, m: np.ndarray) -> list[int | None]:
        """Sums of exact squares; None for what no long holds."""
        x = self.exact(m)
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if x.shape[1] * most * most <= LONG:
            return (x * x).sum(axis=1).tolist()
        x = x.astype(object)
        return [int(s) if s <= LONG else None for s in (x * x).sum(axis=1)]


def summed(chunks: DataFrame, dim: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all chunks of what work gives for the matrix of one."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for _, m in opened(batches, dim):
            total = total + work(m)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.asarray(total, np.float64))], ["k", "value"])

    got = chunks.mapInArrow(go, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()  # as many as work gives
    out = np.zeros(len(got))
    for k, value in got:
        out[k] = value
    return out


def counted(chunks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows, and the exact sum of each dimension."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, m in opened(batches, dim):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(np.r_[m.sum(axis=0, dtype=np.int64), len(m)])], ["k", "value"])

    got = dict(chunks.mapInArrow(go, "k int, value long").groupBy("k").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    return int(got.get(dim, 0)), [int(got.get(k, 0)) for k in range(dim)]


def fresh(rng: np.random.Generator, others: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the columns of others."""
    v = rng.standard_normal(len(others))
    for _ in range(3):
        v -= others @ (others.T @ v)
        v /= np.linalg.norm(v)
    return v


def bidiagonalised(chunks: DataFrame, dim: int, centred: Centred, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values, falling, of the centred rows: at least the k largest."""
    rng, right, left, back = np.random.default_rng(seed), np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    alphas, betas, most = [], [], 0.0
    v = fresh(rng, right)
    while True:
        # Xv, free of the earlier left vectors; left vectors are the rows times the columns of left
        j = left.shape[1]
        a = v - (betas[-1] * left[:, -1] if betas else 0)
        if j:
            first = summed(chunks, dim, lambda m, a=a, left=left: (lambda x: (x @ left).T @ (x @ a))(centred(m)))
            a = a - left @ first if len(first) else a

        def both(m: np.ndarray, a: np.ndarray = a, left: np.ndarray = left) -> np.ndarray:
            x = centred(m)
            w = x @ a
            return np.r_[x.T @ w, w @ w, (x @ left).T @ w]

        got = summed(chunks, dim, both)
        back_w, norm, again = got[:dim], got[dim], got[dim + 1 :]
        alpha = float(np.sqrt(max(norm - again @ again, 0)))
        if alpha > NOTHING * most and alpha > 0:
            u, t = (a - left @ again) / alpha, (back_w - back @ again) / alpha
        else:
            alpha, u, t = 0.0, np.zeros(dim), np.zeros(dim)
        right, left, back = (np.c_[x, y] for x, y in ((right, v), (left, u), (back, t)))
        alphas.append(alpha)
        # X'u, free of the earlier right vectors
        w = t - alpha * v
        for _ in range(2):
            w = w - right @ (right.T @ w)
        beta, most = float(np.linalg.norm(w)), max(most, alpha)
        fine = beta > NOTHING * most and beta > 0
        small = np.diag(alphas) + np.diag(betas, 1)
        p, values, q = np.linalg.svd(small)
        residual = np.abs(p[-1, :k]) * (beta if fine else 0)
        if len(alphas) == dim or fine and len(alphas) >= k and (residual <= SETTLED * values[0]).all():
            return right @ q.T, values
        v = w / beta if fine else fresh(rng, right)
        v -= right @ (right.T @ v)
        v /= np.linalg.norm(v)
        betas.append(beta if fine else 0.0)
        most = max(most, betas[-1])


def whitened(df: DataFrame, k: int = 16, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """<id_col>, component, n, deviation, whitened, explained, identity_error: for each row and each of the k strongest components.

    Components x become floor(scale * x); a constant added to them would change nothing here. Estimates come from the n distinct vectors; rows that repeat a
    vector, or an id, come back all the same. deviation is the exact sum of squares of n x - S, null where no long holds it. Rows whose vector is
    null or holds a null or non-finite component are dropped; shorter vectors are as if filled up with zeros, an empty one too; a null id stays. Components
    without variance (under 1e-12 of the largest, which rounding hides) can't be whitened and don't come back: fewer distinct vectors than dimensions give fewer components, equal vectors or
    an empty table none. Other columns play no part.
    """
    spark = df.sparkSession
    bound_batches(spark)
    v, name = F.col("v"), quoted(id_col)
    kind = df.select(F.col(name)).dtypes[0][1]
    rows = df.select(F.col(name).alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(MOST))), F.lit(float(MOST))))).alias("v"))
    dim, most = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0))).first()
    result = f"{name} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], result)
    rows = rows.select("id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v"))
    chunks = chunks_of(rows.select(F.col("v").alias("vector")).distinct().select(F.lit(0).cast("long").alias("id"), "vector"), dim)
    n, sums = counted(chunks, dim)
    centred = Centred(n, sums, int(most))
    right, values = bidiagonalised(chunks, dim, centred, k)
    e = values**2 / n
    held = int((e[:k] > NOTHING * max(e[0], np.finfo(float).tiny)).sum())
    if not held:
        return spark.createDataFrame([], result)
    weights = right[:, :held] / np.sqrt(e[:held])
    got = summed(chunks, dim, lambda m: (lambda z, x: np.r_[(z.T @ z).ravel(), z.sum(axis=0), (x * x).sum()])(centred(m) @ weights, centred(m)))
    square, mean, trace = got[: held * held].reshape(held, held) / n, got[held * held : -1] / n, got[-1] / n
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(held)).max())
    explained = e[:held] / trace

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(b), dim)
            at, times = np.repeat(np.arange(len(b)), held), len(b)
            deviation = pa.array(centred.deviations(m), pa.int64())
            whole = [np.tile(np.arange(1, held + 1, dtype=np.int32), times), np.full(len(at), n), deviation.take(pa.array(at)), (centred(m) @ weights).ravel(), np.tile(explained, times), np.full(len(at), error)]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at)), *(x if isinstance(x, pa.Array) else pa.array(x) for x in whole)], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(go, result)

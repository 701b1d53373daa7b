"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers, so count, sums and scatter are exact whatever the partitions: tasks add up products of
entries less the rounded mean, and what is left of the mean comes off in whole numbers. The driver sees one number for each pair of
dimensions. The factor's columns are rotated until they are at right angles; their squared norms are the
eigenvalues, the columns over their norms the components.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are left out, and so are
rows of another length than most have (of equally frequent lengths the larger counts); null and repeated keys
and repeated rows stay, each counts; components without spread (rank below ``top``) are not returned, so
equal rows give none; an empty table gives no rows; extra columns are ignored; an entry that, scaled,
exceeds 2**40 raises; a deviation that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values at a time, so that a task's memory doesn't follow the batch.
STEP = 1 << 20
LARGEST = float(1 << 40)
#: Up to here sums of products of doubles are exact.
EXACT = float(1 << 53)
SWEEPS = 60


class Whitening(NamedTuple):
    """n rows, sums by dimension, components as columns by falling eigenvalue, the trace of the covariance."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(key).alias("key"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def whole_numbers(batch: pa.RecordBatch, scale: float, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of whole entries) for each length of vectors in the batch, in steps."""
    column = batch.column(1)
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError("an entry is too large to be a whole number of double precision")
    values = values.astype(np.int64) + shift
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    lengths = np.diff(ends, prepend=0)
    for d in np.unique(lengths):
        own = np.flatnonzero(lengths == d)
        for lo in range(0, len(own), step := max(1, STEP // int(d))):
            at = own[lo : lo + step]
            yield at, values[(ends[at] - d)[:, None] + np.arange(d)]


def exact_products(y: np.ndarray) -> np.ndarray:
    """y.T @ y in whole numbers."""
    most = float(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def counted_sums(rows: DataFrame, scale: float, shift: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension, for the most frequent length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in whole_numbers(batch, scale, shift):
                at = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                at[0] += len(x)
                at[1] += x.sum(axis=0).astype(object)  # under 2**40 each, STEP of them at most
        out = [(d, i, n, str(s)) for d, (n, sums) in found.items() for i, s in enumerate(sums)]
        yield pa.RecordBatch.from_pylist([dict(zip(("d", "i", "n", "s"), r, strict=True)) for r in out], schema=pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))

    parts = rows.mapInArrow(run, "d int, i int, n long, s string")
    sums = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not sums:
        return 0, []
    _, d = max((r["n"], r["d"]) for r in sums)
    own = sorted((r for r in sums if r["d"] == d), key=lambda r: r["i"])
    return own[0]["n"], [int(r["s"]) for r in own]


def scatter(rows: DataFrame, n: int, sums: list[int], scale: float, shift: int) -> np.ndarray:
    """Sum over rows of (n x - S)(n x - S)' over n, in whole numbers: n**2 times the covariance."""
    d, middle = len(sums), np.array([round(s / n) if abs(s) < EXACT else s // n for s in sums], np.int64)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            for _, x in whole_numbers(batch, scale, shift):
                if x.shape[1] == d:
                    total += exact_products(x - middle)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array([str(v) for v in total[upper]], pa.string())], names=["i", "j", "s"])

    parts = rows.mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], object)
    out = -np.outer(rest, rest)
    for i, j, s in parts:
        out[i, j] += n * int(s)
        if i != j:
            out[j, i] += n * int(s)
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """F with v = F F', one column for each pivot that is not noise; rows in the order of v."""
    d = len(v)
    left, out, r = v.diagonal().copy(), np.zeros((d, d)), 0
    floor = d * np.finfo(float).eps * left.max(initial=0)
    while r < d and left[p := int(left.argmax())] > floor:
        column = (v[:, p] - out[:, :r] @ out[p, :r]) / np.sqrt(left[p])
        column[left < 0] = 0  # rows that were pivots have nothing left
        column[p] = np.sqrt(left[p])
        out[:, r] = column
        left -= column * column
        left[p] = -1.0
        r += 1
    return out[:, :r]


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The factor with its columns rotated to right angles, by falling norm; each round turns disjoint pairs."""
    a = factor.copy()
    r = a.shape[1]
    players = [*range(r), *([-1] * (r % 2))]
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(p, q) for p, q in zip(players[:half], players[:half - 1 : -1], strict=True) if p >= 0 and q >= 0]
            players = [players[0], players[-1], *players[1:-1]]
            if not pairs:
                continue
            p, q = (np.array(x) for x in zip(*pairs, strict=True))
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            cosine = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, float(cosine.max()))
            turn = cosine > np.finfo(float).eps
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * (x - t * y), c * (y + t * x)
        if worst <= 4 * np.finfo(float).eps:
            break
    return a[:, np.argsort(-(a * a).sum(axis=0), kind="stable")]


def fit_whitening(rows: DataFrame, scale: float, shift: int) -> Whitening | None:
    """Fitted over all rows (key, v); None without rows."""
    n, sums = counted_sums(rows, scale, shift)
    if not n:
        return None
    exact = scatter(rows, n, sums, scale, shift)
    v = np.array([[x / (n * n) for x in line] for line in exact], np.float64)
    turned = one_sided_jacobi(pivoted_cholesky(v))
    eigenvalues = (turned * turned).sum(axis=0)
    trace = sum(exact.diagonal()) / (n * n)
    return Whitening(n, sums, eigenvalues, turned / np.sqrt(eigenvalues), trace)


def projected(x: np.ndarray, model: Whitening, top: int) -> np.ndarray:
    """Rows of whole entries on the first components, each over the root of its eigenvalue."""
    middle = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([(s % model.n) / model.n for s in model.sums])
    return ((x - middle) - rest) @ (model.components[:, :top] / np.sqrt(model.eigenvalues[:top]))


def identity_error(rows: DataFrame, model: Whitening, top: int, scale: float, shift: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    d, k = len(model.sums), min(top, len(model.eigenvalues))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in whole_numbers(batch, scale, shift):
                if x.shape[1] == d:
                    w = projected(x, model, top)
                    total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "s"])

    sums = rows.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1) * k)
    for i, s in sums:
        total[i] = s
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums over dimensions of (n x - S)**2; None beyond a long."""
    middle = np.array([round(s / model.n) for s in model.sums], np.int64)
    rest = [model.n * int(m) - s for s, m in zip(model.sums, middle, strict=True)]
    bound = float(np.abs(x - middle).max(initial=0)) * model.n + max(map(abs, rest), default=0)
    if bound * bound * x.shape[1] < float(1 << 62):
        off = (x - middle) * model.n + np.array(rest, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = (x - middle).astype(object) * model.n + np.array(rest, object)
    return [s if s < 1 << 63 else None for s in (off * off).sum(axis=1)]


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, top: int = 32) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and component up to ``top``."""
    own = usable(rows, key, vector)
    kind = dict(rows.dtypes)[key]
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(own, scale, shift)
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    d, k = len(model.sums), min(top, len(model.eigenvalues))
    error = identity_error(own, model, top, scale, shift)
    explained = model.eigenvalues[:k] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_numbers(batch, scale, shift):
                if x.shape[1] != d:
                    continue
                size = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(size, model.n, np.int64)),
                        pa.array(deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        pa.array(projected(x, model, top).ravel()),
                        pa.array(np.tile(explained, len(at))),
                        pa.array(np.full(size, error)),
                    ],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.mapInArrow(run, schema).withColumnRenamed("key", key)


__all__ = ["Whitening", "fit_whitening", "one_sided_jacobi", "pivoted_cholesky", "whitened"]

"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation (operator 11).

The centred rows X are reduced to a small upper bidiagonal matrix by alternating products
X v and X' u.  The process works on blocks of ``block`` vectors (1 is the textbook form; then
each entry below is a number): with right blocks V and left blocks U, both orthonormal,

    X V_j = U_(j-1) C_(j-1) + U_j A_j        X' U_j = V_j A_j' + V_(j+1) C_j'

so B, with A on the diagonal and C above it, has the singular values of X on the space that
V spans, and V times its right singular vectors are the components.  A block of as many
vectors as components also finds eigenvalues that repeat.  Every new block is orthogonalised
against all former ones, twice; a space that is exhausted goes on with new random vectors,
until V has as many columns as X or the wanted triplets stand to rounding.

A left block has as many rows as the table, and is never stored: U_j = X P_j with a small
matrix P_j, so a pass gets P in its closure, multiplies each row (t = P'x), and sums t t' and
x t' over all rows: that is X v and X' u in one read.  A pass returns d * block numbers, added up
by Spark.  d / block passes are the most.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from dealgrid.llm.common import written

# The functions of this module travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 1024, 100_000
LIMIT = float(1 << 42)  # entries of this size or more count as not finite: sums stay exact
ROWS = 1 << 13          # rows of one product in a task


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(1024 c) + 100000 of each entry c, as longs.  Rows whose vector is
    null or has a null or non-finite entry are left out.  A written table."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False))))
    return written(fine.select("vec_id", F.transform("v", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long")).alias("x")), "whiten-vectors")


def _matrices(batches, at: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with their vectors as rows of longs; missing last entries are SHIFT
    (c = 0)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            column = part.column(at)
            n = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if len(flat) == d * len(n) and (n == d).all():
                yield part, flat.reshape(len(n), d)
                continue
            x = np.full((len(n), d), SHIFT, dtype=np.int64)
            x[np.arange(d) < n[:, None]] = flat
            yield part, x


def _sums(d: int):
    """(pos, n, s): number of rows and exact sum of each dimension; a row per dimension and task."""
    def run(batches):
        n, s = 0, [0] * d
        for _, x in _matrices(batches, 0, d):
            n += len(x)
            s = [a + int(b) for a, b in zip(s, x.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(v) for v in s], pa.string())], ["pos", "n", "s"])
    return run


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - s/n: whole and remaining part of s/n apart, so that nothing of x is rounded away."""
    whole = np.array([v // n for v in s], dtype=np.int64)
    rest = np.array([(v % n) / n for v in s])
    return (x - whole).astype(np.float64) - rest


def _product(p: np.ndarray, n: int, s: list[int], squares: bool):
    """(pos, value) of the sums over a task's rows of t t' and x t' with t = p'x, and of x'x."""
    d, b = p.shape

    def run(batches):
        g, w, total, seen = np.zeros((b, b)), np.zeros((d, b)), 0.0, False
        for _, x in _matrices(batches, 0, d):
            y = _centred(x, n, s)
            t = y @ p
            g += t.T @ t
            w += y.T @ t
            total += float((y * y).sum()) if squares else 0.0
            seen = True
        if seen:
            values = np.concatenate([g.reshape(-1), w.reshape(-1), [total]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["pos", "value"])
    return run


class Whitening:
    """A fitted whitening: n rows with sums s, components (d x k), eigenvalues, trace."""

    def __init__(self, n: int, s: list[int], components: np.ndarray, eigenvalues: np.ndarray, trace: float):
        self.n, self.s, self.components, self.eigenvalues, self.trace = n, s, components, eigenvalues, trace


def _pass(rows: DataFrame, p: np.ndarray, n: int, s: list[int], squares: bool = False):
    d, b = p.shape
    sums = rows.select("x").mapInArrow(_product(p, n, s, squares), "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
    values = np.zeros(b * b + d * b + 1)
    for pos, value in sums.collect():  # b * b + d * b + 1 rows, whatever the table
        values[pos] = value
    return values[:b * b].reshape(b, b), values[b * b:-1].reshape(d, b), float(values[-1])


def fit(rows: DataFrame, k: int = 8, block: int | None = None, seed: int = 11, tolerance: float = 1e-14) -> Whitening | None:
    """Components of (vec_id, x) rows as ``integer_vectors`` gives them; None without any entry.
    Eigenvalues up to rounding (of the largest) are no components."""
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return None
    sums = rows.select("x").mapInArrow(_sums(d), "pos int, n long, s string").groupBy("pos").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    n, s = sums[0]["n"], [0] * d
    for r in sums:
        s[r["pos"]] = int(r["s"])
    b = min(block or k, d)
    rng = np.random.default_rng(seed)
    v = np.linalg.qr(rng.standard_normal((d, b)))[0]
    right, left_p, left_z = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    upper = np.zeros((0, 0))
    p_last, c_last, trace, floor = np.zeros((d, 0)), np.zeros((0, b)), None, 0.0
    while v.shape[1]:
        # X v, less its part in the last left block; both products of the new left block.
        p = v - p_last @ c_last
        g, w, total = _pass(rows, p, n, s, trace is None)
        if trace is None:
            trace = total
            floor = d * np.finfo(float).eps * max(trace, np.finfo(float).tiny)
        for _ in range(2):
            c = left_p.T @ w
            p, w, g = p - left_p @ c, w - left_z @ c, g - c.T @ c
        e, q = np.linalg.eigh((g + g.T) / 2)
        keep = e > floor
        root = np.sqrt(e[keep])
        p_last, z = p @ q[:, keep] / root, w @ q[:, keep] / root
        a = root[:, None] * q[:, keep].T
        # B grows by the blocks C (above) and A (below it).
        rows_before, columns_before = upper.shape
        grown = np.zeros((rows_before + len(root), columns_before + v.shape[1]))
        grown[:rows_before, :columns_before] = upper
        grown[rows_before - len(c_last):rows_before, columns_before:] = c_last
        grown[rows_before:, columns_before:] = a
        upper, right = grown, np.hstack([right, v])
        left_p, left_z = np.hstack([left_p, p_last]), np.hstack([left_z, z])
        # X' u, less its part in V: the next right block.
        r = z - v @ a.T
        for _ in range(2):
            r = r - right @ (right.T @ r)
        x, sizes, y = np.linalg.svd(r, full_matrices=False)
        go = sizes > np.sqrt(floor)
        v, c_last = x[:, go], (sizes[go, None] * y[go]).T
        v = v - right @ (right.T @ v)
        if upper.size and len(c_last):
            u, values, _ = np.linalg.svd(upper)
            rest = np.linalg.norm(c_last.T @ u[-len(c_last):, :len(values)], axis=0)
            if len(values) >= k and (rest[:k] <= tolerance * values[0]).all():
                break
        if not v.shape[1] and right.shape[1] < d:
            v = rng.standard_normal((d, min(b, d - right.shape[1])))
            for _ in range(2):
                v = np.linalg.qr(v - right @ (right.T @ v))[0]
            c_last = np.zeros((len(root), v.shape[1]))
    _, values, vectors = np.linalg.svd(upper)
    most = (values * values > floor)[:k] if len(values) else np.zeros(0, bool)
    components = right @ vectors[:len(values)][:k][most].T
    # One more pass sets right what rounding in B left between components of unlike size.
    e, q = np.linalg.eigh(_pass(rows, components, n, s)[0])
    return Whitening(n, s, components @ q[:, ::-1], e[::-1] / n, trace / n)


def _whitened(model: Whitening, error: float | None):
    """Output rows, or (error None) the sums over a task of the whitened rows and their products."""
    d, k = model.components.shape
    basis = model.components / np.sqrt(model.eigenvalues)

    def moments(batches):
        m, one, n = np.zeros((k, k)), np.zeros(k), 0
        for _, x in _matrices(batches, 1, d):
            w = _centred(x, model.n, model.s) @ basis
            m, one, n = m + w.T @ w, one + w.sum(axis=0), n + len(x)
        if n:
            values = np.concatenate([m.reshape(-1), one])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["pos", "value"])

    def output(batches):
        mean, names = np.array(model.s, dtype=object), ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for part, x in _matrices(batches, 1, d):
            w = _centred(x, model.n, model.s) @ basis
            low, high = int(x.min(initial=0)), int(x.max(initial=0))
            widest = max(abs(model.n * v - t) for v in (low, high) for t in (min(model.s), max(model.s)))
            if d * widest * widest < 1 << 63:
                far = model.n * x - np.array(model.s, dtype=np.int64)
                far = (far * far).sum(axis=1)
            else:
                exact = ((model.n * x.astype(object) - mean) ** 2).sum(axis=1)
                far = [v if v < 1 << 63 else None for v in exact]
            rows = len(x)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, model.n), pa.int64()), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(w.reshape(-1)), pa.array(np.tile(model.eigenvalues / model.trace, rows)),
                pa.array(np.full(rows * k, error), pa.float64())], names)
    return moments if error is None else output


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = model.components.shape[1]
    sums = rows.mapInArrow(_whitened(model, None), "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
    values = np.zeros(k * k + k)
    for pos, value in sums.collect():  # k * k + k rows
        values[pos] = value
    mean = values[k * k:] / model.n
    return float(np.abs(values[:k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", block: int | None = None) -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Vectors that are null or hold a null or non-finite entry (or one of 2^42 or more) are left
    out; missing last entries of shorter vectors count as 0.  Rows with a null vec_id and
    repeated rows take part as they come.  Components without variance (fewer rows or
    dimensions than k, equal vectors) are left out, so a table of equal vectors, and an empty
    one, gives no rows.  deviation is exact; it is null where it passes 2^63 - 1.  Eigenvalues
    that repeat have any orthonormal basis as components, the same for all rows.  Extra columns
    are ignored.
    """
    rows = integer_vectors(vectors, id_col, vec_col)
    model = fit(rows, k, block)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.components.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_whitened(model, identity_error(rows, model)), schema)

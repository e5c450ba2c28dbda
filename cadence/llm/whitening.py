"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The vectors are turned into whole numbers ``x = floor(scale * c) + shift``, kept as
blocks of rows in a table on shared storage, and centred exactly: with ``S = q n + r``
a centred entry is ``(x - q) - r / n``.  Of the centred matrix X the bidiagonalisation
``X V = U B`` is built one column a pass.  A pass sends the new ``v`` and the ``beta`` of
the last step to the tasks; each forms its part of ``w = X v - beta u``, and the sums
``X'w``, ``U'w`` and ``w'w`` come back (about 2 d numbers).  Left vectors are linear in
the rows (``U = X W`` with a small W kept on the driver), so they are never stored and a
lost executor costs a rerun of its tasks only.  Both sides are orthogonalised
against all earlier vectors in every step.  Where a step breaks down (repeated
eigenvalues, fewer independent columns) the recurrence goes on with a new direction.
The singular values of the small bidiagonal B are the deviations, its right vectors
turn V into the components.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry, are
dropped; so are vectors of another length than most (ties: the longer).  A deviation of
more than 38 digits is null.  Entries beyond
2**53 in size after scaling count as 2**53.  Components whose eigenvalue is not above
``FLAT`` of the largest (constant or dependent columns) cannot be whitened and are left
out, so equal vectors, a single row or an empty table give no rows.  Null and repeated
ids are carried along as they are; columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import bounded_batches
from cadence.plans.session import materialize

#: Rows of a block; a block of 64 columns is 0.5 MB.
BLOCK_ROWS = 1024
#: Size up to which scaled entries are kept as they are.
LARGEST = float(1 << 53)
#: Part of the largest eigenvalue up to which another one counts as nothing.
FLAT = 1e-13
#: Partial sums that the driver adds up by itself; more are added up in tasks first.
GATHERED = 256


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: count and exact sums of the fit list, components as columns,
    eigenvalues of the covariance, its trace, and the largest entry by which the
    covariance of the whitened rows differs from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over columns of (n x - S)**2 of every row, exactly."""
        q, r = _quotients(self.n, self.sums)
        away = x - q
        most = int(np.abs(away).max(initial=0)) * self.n + self.n
        if most * most * max(1, x.shape[1]) >= 1 << 63:
            away, r = away.astype(object), r.astype(object)
        d = away * self.n - r
        return [int(s) for s in (d * d).sum(axis=1)]


def _quotients(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    both = np.array([divmod(s, n) for s in sums], dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    q, r = _quotients(n, sums)
    return (x - q) - r / n


# --- blocks of rows ----------------------------------------------------------

def blocks(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """(width, size, ids, x): up to ``BLOCK_ROWS`` usable vectors of one length a row,
    x as the bytes of a little-endian matrix of 64-bit numbers, on shared storage."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

    bounded_batches(df.sparkSession, BLOCK_ROWS)
    given = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    schema = StructType([StructField("width", IntegerType()), StructField("size", IntegerType()),
                         StructField("ids", ArrayType(given.schema["id"].dataType)), StructField("x", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            v = b.column(1)
            v = v.filter(v.is_valid())
            ids = b.column(0).filter(b.column(1).is_valid())
            widths = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)  # null entries as NaN
            for width in np.unique(widths):
                if not width:
                    continue
                rows = np.flatnonzero(widths == width)
                first = np.concatenate(([0], np.cumsum(widths)))[rows]
                c = flat[first[:, None] + np.arange(width)]
                good = np.isfinite(c).all(axis=1)
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(scale * c[good]), -LARGEST, LARGEST).astype("<i8") + shift
                own = ids.take(pa.array(rows[good]))
                for at in range(0, len(x), BLOCK_ROWS):
                    part = x[at:at + BLOCK_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([width], pa.int32()), pa.array([len(part)], pa.int32()),
                         pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), own.slice(at, len(part)),
                                                  type=arrow.field("ids").type),
                         pa.array([part.tobytes()], arrow.field("x").type)], schema=arrow)

    return materialize(given.mapInArrow(run, schema), "blocks")


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, width)


def _column_sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(rows, exact sum of every column) of each width."""
    import pyarrow as pa

    def run(batches):
        found: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for width, data in zip(b.column("width").to_pylist(), b.column("x").to_pylist()):
                x = _matrix(data, width)
                fits = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
                s = (x if fits else x.astype(object)).sum(axis=0).astype(object)
                n, t = found.get(width, (0, 0))
                found[width] = (n + len(x), t + s)
        for width, (n, s) in found.items():
            yield pa.RecordBatch.from_pydict({"width": [width] * (width + 1), "place": list(range(-1, width)),
                                              "total": [str(n), *map(str, s)]})

    parts = rows.select("width", "x").mapInArrow(run, "width long, place long, total string")
    totals = parts.groupBy("width", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[int, list[int]] = {}
    for r in totals.orderBy("width", "place").collect():  # columns of a vector, not rows of the table
        out.setdefault(r["width"], []).append(int(r["total"]))
    return {width: (t[0], t[1:]) for width, t in out.items()}


def _summed(rows: DataFrame, tasks: int, part, length: int) -> np.ndarray:
    """The sum of ``part(x)`` (``length`` numbers) over the matrices of all blocks."""
    import pyarrow as pa

    def one(total):
        return pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    def sums(batches):
        total, width = np.zeros(length), None
        for b in batches:
            for width, data in zip(b.column("width").to_pylist(), b.column("x").to_pylist()):
                total += part(_matrix(data, width))
        if width is not None:
            yield one(total)

    def again(batches):
        total = np.zeros(length)
        for b in batches:
            for t in b.column("total").to_pylist():
                total += np.frombuffer(t)
        yield one(total)

    found = rows.select("width", "x").mapInArrow(sums, "total binary")
    if tasks > GATHERED:
        found = found.repartition(math.isqrt(tasks)).mapInArrow(again, "total binary")
    return np.sum([np.zeros(length), *(np.frombuffer(r["total"]) for r in found.collect())], axis=0)


# --- bidiagonalisation ---------------------------------------------------------

def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` without its part in the span of the columns of ``basis`` (twice, against rounding)."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def _new_direction(basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    v = _orthogonal(rng.standard_normal(len(basis)), basis)
    return v / np.linalg.norm(v)


def bidiagonalise(product, width: int, steps: int, wanted: int, tolerance: float | None = None):
    """(V, alphas, betas) of ``X V = U B``, B upper bidiagonal.

    ``product(v, beta, w_last, W)`` gives the sums ``X'w``, ``U'w`` and ``w'w`` of
    ``w = X v - beta X w_last`` and ``U = X W``.  All ``steps`` are made unless a
    ``tolerance`` is given: then it ends as soon as the ``wanted`` largest singular
    values are known to that part of the largest one (copies of a repeated value may
    then be missing)."""
    rng = np.random.default_rng(11)
    V, W, M = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((width, 0))  # M = X'U
    alphas, betas = [], []
    v, beta, largest = _new_direction(V, rng), 0.0, 0.0
    for k in range(steps):
        V = np.column_stack([V, v])
        last = W[:, -1] if W.shape[1] else np.zeros(width)
        g, c, ww = product(v, beta, last, W)
        alpha = math.sqrt(max(0.0, ww - float(c @ c)))
        largest = max(largest, alpha, beta)
        if alpha <= 1e-13 * largest:  # Xv lies in the span of the earlier u
            alphas.append(0.0)
            W, M = np.column_stack([W, np.zeros(width)]), np.column_stack([M, np.zeros(width)])
            r, beta = np.zeros(width), 0.0
        else:
            alphas.append(alpha)
            u = (v - beta * last - W @ c) / alpha
            xu = (g - M @ c) / alpha
            W, M = np.column_stack([W, u]), np.column_stack([M, xu])
            r = _orthogonal(xu - alpha * v, V)
            beta = float(np.linalg.norm(r))
        if k + 1 == steps:
            break
        if beta <= 1e-13 * largest:
            beta = 0.0
            v = _new_direction(V, rng)
        else:
            v = r / beta
        if tolerance is not None and beta and k + 1 >= wanted:
            left, s, _ = np.linalg.svd(_bidiagonal(alphas, betas))
            if (beta * np.abs(left[-1, :wanted]) <= tolerance * s[0]).all():
                break
        betas.append(beta)
    return V, np.array(alphas), np.array(betas[:len(alphas) - 1])


def _bidiagonal(alphas, betas) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1)


def fit(rows: DataFrame, components: int = 32, tolerance: float | None = None) -> Whitening | None:
    """The whitening of all vectors in ``rows`` (from ``blocks``); None if nothing varies."""
    totals = _column_sums(rows)
    if not totals:
        return None
    width = max(totals, key=lambda w: (totals[w][0], w))
    n, sums = totals[width]
    same = rows.filter(F.col("width") == width)
    tasks = rows.rdd.getNumPartitions()

    def product(v, beta, last, W):
        k = W.shape[1]

        def part(x):
            c = _centred(x, n, sums)
            w = c @ v - beta * (c @ last)
            return np.concatenate([c.T @ w, (c @ W).T @ w, [w @ w]])

        s = _summed(same, tasks, part, width + k + 1)
        return s[:width], s[width:-1], float(s[-1])

    wanted = min(components, width, n)
    V, alphas, betas = bidiagonalise(product, width, width, wanted, tolerance)
    _, deviations, right = np.linalg.svd(_bidiagonal(alphas, betas))
    values = deviations ** 2 / n
    if not values[0] > 0:
        return None
    wanted = int((values[:wanted] > FLAT * values[0]).sum())
    found = V @ right[:wanted].T
    found /= np.linalg.norm(found, axis=0)
    scaled = found / np.sqrt(values[:wanted])

    def moments(x):
        c = _centred(x, n, sums)
        z = c @ scaled
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel(), [(c * c).sum()]])

    s = _summed(same, tasks, moments, wanted + wanted * wanted + 1)
    mean = s[:wanted] / n
    covariance = s[wanted:-1].reshape(wanted, wanted) / n - np.outer(mean, mean)
    return Whitening(n, sums, found, values[:wanted], float(s[-1]) / n, float(np.abs(covariance - np.eye(wanted)).max()))


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation
    (decimal, exact), whitened, explained, identity_error."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import (DecimalType, DoubleType, IntegerType, LongType, StructField, StructType)

    schema = StructType([StructField(key, rows.schema["ids"].dataType.elementType), StructField("component", IntegerType()),
                         StructField("n", LongType()), StructField("deviation", DecimalType(38, 0)),
                         StructField("whitened", DoubleType()), StructField("explained", DoubleType()),
                         StructField("identity_error", DoubleType())])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)
    k, width = len(model.eigenvalues), len(model.sums)
    scaled = model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def run(batches):
        for b in batches:
            for ids, data in zip(b.column("ids"), b.column("x").to_pylist()):
                x = _matrix(data, width)
                row = np.repeat(np.arange(len(x)), k)
                away = pa.array([str(d) if d < 10 ** 38 else None for d in model.deviations(x)]).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(row), model.n, dtype=np.int64)), away.take(pa.array(row)),
                     pa.array((model.centred(x) @ scaled).ravel()), pa.array(np.tile(explained, len(x))),
                     pa.array(np.full(len(row), model.identity_error))], schema=arrow)

    return rows.filter(F.col("width") == width).select("ids", "x").mapInArrow(run, schema)

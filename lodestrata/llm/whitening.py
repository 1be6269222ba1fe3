"""Embedding whitening by shifted CholeskyQR over rows that stay where they are.

Vectors are put on a lattice of whole numbers, and each distinct one counts once. The centred rows A are never
gathered: a pass solves them against the triangular factors found so far, in tasks, and sums the products of what comes
out (the Gram matrix, d x d numbers a task). The first factor is taken from the shifted Gram matrix, so it exists
however badly the columns depend on each other; further passes orthogonalise again until the Gram matrix has nothing
but ones, and zeros where the rows have no variance. The factors compose to R with A = QR; the singular values and
right vectors of R are those of A, so no covariance matrix of A is ever decomposed.

The driver holds d x d numbers, d at most ``MOST_DIMENSIONS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Entries are held at this bound after scaling, so that they and the sums of a batch stay exact.
BOUND = 1 << 52
MOST_DIMENSIONS = 4096
#: Vectors that are worked on at once.
ROWS = 1024
#: Gram passes at most. Three are the rule, more only where columns nearly depend on each other.
PASSES = 8
#: Components of a variance under this share of the largest are noise of directions without variance.
NOISE = 1e-13


def lattice(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x): x holds floor(scale * entry) + offset for each entry, as little-endian 64-bit numbers.

    Rows whose vector is null or has a null or non-finite entry are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            there = batch.filter(batch.column(1).is_valid())
            vectors = there.column(1)
            entry = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            good = np.bincount(np.repeat(np.arange(len(lengths)), lengths), ~np.isfinite(entry), minlength=len(lengths)) == 0
            entry = entry[np.repeat(good, lengths)]
            x = np.clip(np.floor(scale * entry), -BOUND, BOUND).astype("<i8") + offset
            ends = np.r_[0, np.cumsum(8 * lengths[good])].astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([there.column(0).filter(pa.array(good)), data], ["vec_id", "x"])

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, x binary")


def _numbers(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS).to_pylist()
        yield np.frombuffer(b"".join(part), "<i8").reshape(len(part), size)


def _sums(fit: DataFrame, size: int) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            for x in _numbers(batch.column(0), size):
                total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        if any(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["at", "s"])

    found = fit.mapInArrow(run, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()  # a row for each dimension
    out = [0] * size
    for r in found:
        out[r["at"]] = int(r["s"])
    return out


class Centre:
    """n and the sums of the fit list; what is centred is first made small, so no digit is lost."""

    def __init__(self, n: int, sums: list[int]):
        self.n, parts = n, [divmod(s, n) for s in sums]
        self.whole, self.rest = np.array([q for q, _ in parts], dtype=np.int64), np.array([r for _, r in parts], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; null beyond what a long holds."""
        apart = x - self.whole
        most = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * apart - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * apart.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows . r^-1 for an upper triangular r, both transposed so that a step works on whole lines."""
    out = np.empty_like(rows)
    for j in range(len(r)):
        out[j] = (rows[j] - r[:j, j] @ out[:j]) / r[j, j]
    return out


def _gram(fit: DataFrame, size: int, width: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the products of what ``made`` gives for them (width x rows)."""
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            for x in _numbers(batch.column(0), size):
                q = made(x)
                total += q @ q.T
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i)), pa.int32()), pa.array(total[i, j])], ["at", "v"])

    found = fit.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # width squared at most
    out = np.zeros((width, width))
    at, v = (found.column(c).to_numpy() for c in ("at", "v"))
    out[i[at], j[at]] = out[j[at], i[at]] = v
    return out


def factor(fit: DataFrame, size: int, centre: Centre) -> np.ndarray:
    """R (upper triangular but for its last factor) with R'R = A'A for the centred rows A."""
    factors: list[np.ndarray] = []
    composed = np.eye(size)
    for done in range(PASSES):

        def made(x: np.ndarray, factors: list[np.ndarray] = factors) -> np.ndarray:
            q = np.ascontiguousarray(centre.centred(x).T)
            for r in factors:
                q = solved(q, r)
            return q

        gram = _gram(fit, size, size, made)
        values, vectors = np.linalg.eigh(gram)
        if values[-1] <= 0:
            return np.zeros((size, size))
        if done >= 2 and np.all((values > 0.9) | (values < 1e-6)) or done == PASSES - 1:
            break
        shift = 0.0 if done and values[0] > 0.5 else 11 * (centre.n * size + size * (size + 1)) * np.finfo(float).eps / 2 * values[-1]
        step = np.linalg.cholesky(gram + shift * np.eye(size)).T
        factors = [*factors, step]
        composed = step @ composed
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T @ composed  # the last Gram matrix is near to ones and zeros


def fit_whitening(vectors: DataFrame, components: int = 16) -> dict:
    """The model of lattice vectors (vec_id, x): size, n, centre, weights (a column each component), explained, identity_error.

    Vectors of another length than most distinct ones have (ties: the longest) are not fitted. Components without
    variance are none; a table without vectors, or of one distinct vector, has no components.
    """
    fit = cut(vectors.select("x").distinct(), "fit")
    size = fit.groupBy(F.length("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if size is None or not size["size"]:
        return {"size": 0, "n": 0, "weights": np.zeros((0, 0)), "explained": np.zeros(0), "identity_error": 0.0, "centre": None}
    d, n = size["size"] // 8, size["n"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; {MOST_DIMENSIONS} at most")
    fit = fit.where(F.length("x") == 8 * d)
    centre = Centre(n, _sums(fit, d))
    r = factor(fit, d, centre)
    _, singular, right = np.linalg.svd(r)
    variance = singular**2 / n
    count = min(components, int((variance > NOISE * variance[0]).sum())) if variance[0] > 0 else 0
    lines = right[:count]
    lines = lines * np.sign(lines[np.arange(count), np.abs(lines).argmax(axis=1)])[:, None] if count else lines
    weights = (lines / np.sqrt(variance[:count, None])).T
    error = 0.0
    if count:
        both = _gram(fit, d, count + 1, lambda x: np.vstack([(centre.centred(x) @ weights).T, np.ones(len(x))])) / n
        error = float(np.abs(both[:count, :count] - np.outer(both[count, :count], both[count, :count]) - np.eye(count)).max())
    return {"size": d, "n": n, "centre": centre, "weights": weights, "explained": variance[:count] / variance.sum() if count else np.zeros(0), "identity_error": error}


def whiten(vectors: DataFrame, model: dict) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of each lattice vector of the model's length; the others are left out."""
    size, centre, weights = model["size"], model["centre"], model["weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for x in _numbers(batch.column(1), size):
                white = centre.centred(x) @ weights
                ends = np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre.deviations(x), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))], ["vec_id", "deviation", "whitened"])

    return vectors.where(F.length("x") == 8 * size).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whitened_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row per row of ``rows`` with a usable vector and component: vec_id, component (from 1 by falling variance), n,
    deviation, whitened, explained, identity_error.

    Unusable are vectors that are null or hold a null or non-finite entry, and those of another length than most. Rows
    repeat as in ``rows``, null ids stay null, other columns are not read. Entries beyond 2^52 / ``scale`` in size count as that.
    Without variance (no row, or one distinct vector) there are no components and the result is empty.
    """
    vectors = lattice(rows, id_col, vector_col, scale, offset)
    model = fit_whitening(vectors, components)
    if not model["weights"].size:
        return vectors.where("false").selectExpr("vec_id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    out = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(e)) for e in model["explained"]))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(model["identity_error"]).alias("identity_error"))

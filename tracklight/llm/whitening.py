"""Whitening of embeddings by incremental eigendecomposition.

Each partition keeps the count, mean and spectrum (eigenvalues and eigenvectors) of the scatter of
its vectors, and brings in every vector as a centred rank-one update: the new eigenvalues are the
roots of a secular equation, after deflation of what the update does not touch. Spectra are
combined in a tree, one into the other by a rank-one update for each eigenvector and one for the
distance of the means. A distributed Rayleigh-Ritz step over all vectors, centred by their exact
mean, then takes away what rounding has left in the basis.

The state of a partition has dims^2 doubles, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.llm.common import checkpointed

SCALE, SHIFT = 1024, 100_000
#: Entries of this size and more have no exact whole number in a double.
BOUND = float(1 << 42)
COMPONENTS = 8
#: Spectra that one task combines.
FAN_IN = 16
#: Sums of whole numbers are kept in two parts, so that they do not overflow.
LOW = 26


class Spectrum:
    """Eigenvalues (rising) and eigenvectors (columns) of a growing scatter matrix."""

    def __init__(self, dims: int):
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def update(self, v: np.ndarray, rho: float) -> None:
        """Add rho * v v', rho > 0."""
        d, q = self.values, self.vectors
        z = v @ q
        weight = rho * (z @ z)
        if not weight > 0:
            return
        eps = np.finfo(float).eps
        tolerance = 8 * eps * max(abs(d[-1]), abs(d[0]), weight)
        # Deflation: of eigenvalues that are the same a reflection leaves only the first with a
        # part in the update; what has no part in it stays.
        new = np.diff(d, prepend=-np.inf) > tolerance
        if not new.all():
            edges = np.append(np.flatnonzero(new), len(d))
            for start, end in zip(edges[:-1], edges[1:]):
                if end - start > 1:
                    _reflect(z, q, start, end)
        part = np.sqrt(rho * weight) * np.abs(z) > tolerance
        if not part.any():
            return
        roots, vectors = secular(d[part], z[part], rho)
        d[part] = roots
        q[:, part] = q[:, part] @ vectors
        order = np.argsort(d, kind="stable")
        if (order[1:] < order[:-1]).any():
            self.values, self.vectors = d[order], q[:, order]


def _reflect(z: np.ndarray, q: np.ndarray, start: int, end: int) -> None:
    part = z[start:end]
    norm = np.linalg.norm(part)
    mirror = part.copy()
    mirror[0] += np.copysign(norm, part[0])
    size = mirror @ mirror
    if size > 0:
        block = q[:, start:end]
        block -= np.outer(block @ mirror, 2 / size * mirror)
        first = -np.copysign(norm, part[0])
        part[:] = 0
        part[0] = first


def secular(d: np.ndarray, z: np.ndarray, rho: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho * z z' for rising, different d and z without zeros.

    Root j of 1 + rho * sum(z_i^2 / (d_i - x)) lies between d_j and d_j+1. It is sought as the
    distance from the nearer of the two, by the function with these two poles that has the value
    and the slopes of both sides; a step that leaves the bracket becomes a bisection. Eigenvectors
    come from the z that has the found roots exactly, so they are orthogonal.
    """
    k = len(d)
    w = rho * z * z
    ends = np.append(d[1:], d[-1] + w.sum())
    gaps = ends - d
    left = np.arange(k)[:, None] <= np.arange(k)  # poles at or below root j
    apart = d[:, None] - d
    middle = 1 + (w[:, None] / (apart - gaps / 2)).sum(axis=0)
    near = (middle < 0) & (np.arange(k) < k - 1)  # the upper pole is the origin
    origin = np.arange(k) + near
    delta = d[:, None] - d[origin]
    low, high = np.where(near, -gaps, 0.0), np.where(near, 0.0, gaps)
    at_low, at_high = low.copy(), high.copy()  # the poles beside the root
    low, high = np.where(middle < 0, low + gaps / 2, low), np.where(middle < 0, high, high - gaps / 2)
    x = (low + high) / 2
    open_ = np.ones(k, bool)
    eps = np.finfo(float).eps
    for _ in range(rounds):
        distance = delta - x
        terms = w[:, None] / distance
        slopes = terms / distance
        psi, phi = np.where(left, terms, 0), np.where(left, 0, terms)
        below, above = psi.sum(axis=0), phi.sum(axis=0)
        f = 1 + below + above
        open_ &= np.abs(f) > eps * k * (1 + np.abs(below) + np.abs(above))
        open_ &= high - low > 2 * eps * np.maximum(np.abs(low), np.abs(high))
        if not open_.any():
            break
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        to_low, to_high = at_low - x, at_high - x
        a = np.where(left, slopes, 0).sum(axis=0) * to_low**2
        b = np.where(left, 0, slopes).sum(axis=0) * to_high**2
        with np.errstate(all="ignore"):
            c = f - a / to_low - b / to_high
            # c * (at_low - y) * (at_high - y) + a * (at_high - y) + b * (at_low - y) = 0
            p = c * (at_low + at_high) + a + b
            q = c * at_low * at_high + a * at_high + b * at_low
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            far = (p + np.copysign(root, p)) / 2
            first, second = q / far, far / c
        y = np.where((first > low) & (first < high), first, second)
        y = np.where((y > low) & (y < high), y, (low + high) / 2)
        x = np.where(open_, y, x)
    distance = delta - x
    # |z_i|^2 = prod_j(x_j - d_i) / prod_{j != i}(d_j - d_i) / rho
    np.fill_diagonal(apart, 1.0)
    ratio = -distance / np.where(np.eye(k, dtype=bool), 1.0, apart.T)
    z = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1)) / rho), z)
    vectors = z[:, None] / distance
    return d[origin] + x, vectors / np.linalg.norm(vectors, axis=0)


# -- states of partitions -------------------------------------------------------------------------

_STATE = "part long, n long, low array<long>, high array<long>, mean array<double>, values array<double>, vectors array<double>"
_SUMS = "part long, n long, sums array<double>"


def _state(part: int, n: int, low, high, mean, spectrum: Spectrum) -> pa.RecordBatch:
    arrays = (low, high, mean, spectrum.values, spectrum.vectors.ravel())
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([n]), *[pa.array([a]) for a in arrays]],
        names=["part", "n", "low", "high", "mean", "values", "vectors"],
    )


def whole(c: np.ndarray) -> np.ndarray:
    """Entries as whole numbers."""
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            entries = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            yield batch, whole(entries.reshape(-1, dims))


def spectra(rows: DataFrame, dims: int) -> DataFrame:
    """The state of each partition after an update by each of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, mean, spectrum = 0, 0, np.zeros(dims), Spectrum(dims)
        low, high = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch, block in _blocks(batches, dims):
            part = batch.column("part")[0].as_py()
            low += (block & (1 << LOW) - 1).sum(axis=0)
            high += (block >> LOW).sum(axis=0)
            for x in block.astype(float):
                away = x - mean
                spectrum.update(away, n / (n + 1))
                n += 1
                mean += away / n
        if n:
            yield _state(part, n, low, high, mean, spectrum)

    placed = rows.select(F.spark_partition_id().cast("long").alias("part"), "embedding")
    return _tree(placed.mapInArrow(run, _STATE), lambda table: _combined(table, dims), _STATE)


def _combined(table: pa.Table, dims: int) -> pa.RecordBatch:
    """The spectra of some partitions as one, by rank-one updates."""
    states = sorted(table.to_pylist(), key=lambda s: s["part"])
    part, n, mean, spectrum = states[0]["part"] // FAN_IN, 0, np.zeros(dims), Spectrum(dims)
    low, high = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for s in states:
        other, vectors = np.array(s["mean"]), np.array(s["vectors"]).reshape(dims, dims)
        if n:
            for value, vector in zip(s["values"], vectors.T):
                if value > 0:
                    spectrum.update(vector, value)
            spectrum.update(other - mean, n * s["n"] / (n + s["n"]))
        else:
            spectrum.values, spectrum.vectors = np.array(s["values"]), vectors
        n += s["n"]
        mean += (other - mean) * (s["n"] / n)
        low += np.array(s["low"])
        high += np.array(s["high"])
    return _state(part, n, low, high, mean, spectrum)


def _tree(states: DataFrame, combine: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """States of partitions combined until one is left; a task combines no more than `FAN_IN`."""
    states = checkpointed(states)
    while states.agg(F.max("part")).first()[0]:
        groups = states.groupBy(F.floor(F.col("part") / FAN_IN))
        states = checkpointed(groups.applyInArrow(lambda t: pa.Table.from_batches([combine(t)]), schema))
    return states


def _summed(rows: DataFrame, made: Callable[[np.ndarray], np.ndarray], dims: int) -> np.ndarray | None:
    """The sum over all blocks of vectors of what `made` gives for each, None without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = 0, None
        for batch, block in _blocks(batches, dims):
            part, sums = batch.column("part")[0].as_py(), made(block).ravel()
            total = sums if total is None else total + sums
        if total is not None:
            yield _row(part, total)

    def combine(table: pa.Table) -> pa.RecordBatch:
        states = sorted(table.to_pylist(), key=lambda s: s["part"])
        return _row(states[0]["part"] // FAN_IN, np.sum([s["sums"] for s in states], axis=0))

    def _row(part: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([0]), pa.array([sums])], names=["part", "n", "sums"])

    placed = rows.select(F.spark_partition_id().cast("long").alias("part"), "embedding")
    last = _tree(placed.mapInArrow(run, _SUMS), combine, _SUMS).first()
    return None if last is None else np.array(last["sums"])


# -- models ---------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """n vectors with sums S; components are columns, in falling order of their values."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def away(self, block: np.ndarray) -> np.ndarray:
        """n * x - S of each vector, exact; Python's numbers where 64 bits do not hold it."""
        most = max(abs(int(block.max(initial=0))), abs(int(block.min(initial=0))))
        sums = self.sums
        if self.n * most + max(map(abs, sums), default=0) < 1 << 63:
            return self.n * block - np.array(sums, np.int64)
        return self.n * block.astype(object) - np.array(sums, object)

    def centred(self, block: np.ndarray) -> np.ndarray:
        return self.away(block).astype(float) / self.n

    def whitened(self, block: np.ndarray) -> np.ndarray:
        return self.centred(block) @ self.components / np.sqrt(self.values)

    def deviation(self, block: np.ndarray) -> list[int | None]:
        """The sum of squares of n * x - S; None where a long does not hold it."""
        away = self.away(block)
        most = max(abs(int(away.max(initial=0))), abs(int(away.min(initial=0))))
        if most * most * away.shape[1] < 1 << 63:
            return (away * away).sum(axis=1).tolist()
        totals = (away.astype(object) ** 2).sum(axis=1).tolist()
        return [t if t < 1 << 63 else None for t in totals]


def usable(embedding: str) -> Column:
    """Whether a vector has entries, all of them numbers below `BOUND`."""
    good = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < BOUND))
    return F.coalesce(good & (F.size(embedding) > 0), F.lit(False))


def usable_rows(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the usable vectors of the commonest length, and that length.

    Of two lengths that are as common the shorter counts; 0 stands for no vectors.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count()
    first = lengths.orderBy(F.desc("count"), "dims").first()
    dims = first["dims"] if first else 0
    return rows.where(F.size("embedding") == dims), dims


def fit(rows: DataFrame, dims: int) -> Whitening | None:
    """The whitening of all vectors of `usable_rows`; None if there are none."""
    state = spectra(rows, dims).first()
    if state is None:
        return None
    sums = [(h << LOW) + s for h, s in zip(state["high"], state["low"])]
    basis = np.array(state["vectors"]).reshape(dims, dims)[:, ::-1]
    model = Whitening(state["n"], sums, basis, np.ones(dims), 0.0)

    def projected(block: np.ndarray) -> np.ndarray:
        y = model.centred(block) @ basis
        return y.T @ y

    # Rayleigh-Ritz: the covariance in the basis that the updates gave is all but diagonal.
    ritz = _summed(rows, projected, dims).reshape(dims, dims) / state["n"]
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    components = np.linalg.qr(basis)[0] @ (np.sign(np.diag(np.linalg.qr(basis)[1]))[:, None] * turn)
    order = np.argsort(-values, kind="stable")
    values, components = values[order], components[:, order]
    at = np.abs(components).argmax(axis=0)
    components = components * np.sign(components[at, np.arange(dims)])
    return Whitening(state["n"], sums, components, values, float(np.trace(ritz)))


def top(model: Whitening, k: int = COMPONENTS) -> Whitening:
    """The first k components; those without variance, but for rounding, are left out."""
    dims = len(model.values)
    kept = int((model.values[:k] > 64 * dims * np.finfo(float).eps * max(model.values[0], 0)).sum())
    return Whitening(model.n, model.sums, model.components[:, :kept], model.values[:kept], model.trace)


def identity_error(rows: DataFrame, dims: int, model: Whitening) -> float:
    """The largest absolute entry of the covariance of all whitened vectors less the identity."""
    k = len(model.values)

    def moments(block: np.ndarray) -> np.ndarray:
        w = model.whitened(block)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sums = _summed(rows, moments, dims) / model.n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error.

    A row for each vector of `vectors` (vec_id, embedding) and each of the first k components; other
    columns are not read. Vectors that are NULL or empty, hold NULL, non-finite entries or entries
    of 2^42 and more, or have another length than most, are left out. Components without variance
    are left out too, so equal vectors give no rows. NULL and repeated ids are kept. `deviation` is
    NULL where a long does not hold it. The sign of a component makes its largest entry positive.
    """
    rows, dims = usable_rows(vectors)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, dims) if dims else None
    model = top(model, k) if model else None
    if not model or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, dims, model)
    kept, explained = len(model.values), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks(batches, dims):
            n = len(block)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(n), kept))),
                "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), n),
                "n": np.full(n * kept, model.n),
                "deviation": pa.array(model.deviation(block), pa.int64()).take(pa.array(np.repeat(np.arange(n), kept))),
                "whitened": model.whitened(block).ravel(),
                "explained": np.tile(explained, n),
                "identity_error": np.full(n * kept, error),
            })

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, schema)

"""Whitening of vectors by an incremental eigendecomposition.

Entries are taken as whole numbers, and every different vector counts once. Each task keeps
the spectrum of the scatter of what it has read, eigenvectors and eigenvalues around a mean.
A further vector adds one symmetric matrix of rank one: its product with the eigenvectors
gives the secular equation, whose roots are the new eigenvalues; coordinates that are zero
and eigenvalues that are equal are deflated. The eigenvectors are made of roots and poles
by the formula of Löwner, which keeps them at right angles.

The spectra of tasks are added up in the same way, one eigenvector of the one after the
other added to the other, in groups of a bounded number and size, level by level. What
comes out is a basis, which a last pass over all vectors refines: the covariance in that
basis is summed in Spark, and its eigenvectors (Rayleigh-Ritz) are the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import extended, free_name, settle, ship

#: What an entry is multiplied by before it is rounded down.
SCALE = 256
#: Results that are added up in one task of the next level, or in the driver at last: so many, of 64 MB together, or two.
FAN_IN, FAN_BYTES = 32, 64 << 20
_ROUNDS = 60
_EPS = float(np.finfo(np.float64).eps)


def roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + rho z z', for rising different d, z without zeros, rho > 0.

    Root i lies between ``d[i]`` and the next one. It is given as its nearer pole p and its
    distance from it, so that distances from poles can be computed without loss. All roots
    are found at once. The secular equation is replaced by c + w / (d[p] - x) + s / (d[q] - x),
    with the true weight w of the pole p, and c and s so that value and slope agree; q is the
    interval's other end, or for the last root the pole before. The root of that is the next
    guess; if it is outside of what is known, the middle is.
    """
    n, weight = len(d), rho * z * z
    if n == 1:
        return np.zeros(1, np.int64), weight
    right = np.append(d[1:], d[-1] + weight.sum())
    half = (right - d) / 2
    above = 1 + (1 / ((d[None, :] - d[:, None]) - half[:, None])) @ weight < 0
    pole = np.arange(n) + (above & (np.arange(n) < n - 1))
    other = 2 * np.arange(n) + 1 - pole
    other[-1] = n - 2
    delta = d[None, :] - d[pole][:, None]
    b0, w = d[other] - d[pole], weight[pole]
    low, high = np.where(above, half, 0.0), np.where(above, 2 * half, half)
    low, high = (np.where(pole > np.arange(n), side - 2 * half, side) for side in (low, high))
    off, last = (low + high) / 2, np.arange(n) == n - 1
    for _ in range(_ROUNDS):
        part = 1 / (delta - off[:, None])
        value, slope, size = 1 + part @ weight, (part * part) @ weight, 1 + np.abs(part) @ weight
        done = np.abs(value) <= n * _EPS * size
        if done.all():
            break
        low, high = np.where(value < 0, off, low), np.where(value < 0, high, off)
        a, b = -off, b0 - off
        s = (slope - w / (a * a)) * b * b
        c = value - w / a - s / b
        p, q = c * (a + b) + w + s, c * a * b + w * b + s * a
        root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
        root[-1] *= -1  # the last root lies beyond both poles
        guess = off + np.where((p > 0) ^ last, 2 * q / (p + root), (p - root) / (2 * c))
        good = (guess > low) & (guess < high)
        guess = np.where(done, off, np.where(good, guess, (low + high) / 2))
        if (np.abs(guess - off) <= 2 * _EPS * np.abs(off)).all():
            break
        off = guess
    return pole, off


def updated(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) with rho v v' added to the matrix."""
    z = v @ vectors
    norm = float(np.sqrt(z @ z))
    if norm == 0 or rho <= 0:
        return values, vectors
    z = z / norm
    rho = rho * norm * norm
    tiny = 8 * _EPS * max(float(np.abs(values).max()), rho)
    vectors = vectors.copy()
    for i in np.flatnonzero(np.diff(values) <= tiny):  # equal eigenvalues: turn one coordinate to zero
        if z[i] == 0:
            continue
        r = float(np.hypot(z[i], z[i + 1]))
        c, s = z[i + 1] / r, z[i] / r
        vectors[:, [i, i + 1]] = vectors[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
        z[i], z[i + 1] = 0.0, r
    use = np.flatnonzero(np.abs(rho * z) > tiny)
    if not len(use):
        return values, vectors
    d, w = values[use], z[use]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        pole, off = roots(d, w, rho)
    gap = (d[None, :] - d[pole][:, None]) - off[:, None]  # gap[i, k] = d[k] - root i
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1.0)
    exact = np.sqrt(np.abs(gap / apart).prod(0)) * np.sign(w)  # the z that has exactly these roots
    turned = exact[:, None] / gap.T
    turned /= np.sqrt((turned * turned).sum(0))
    values = values.copy()
    values[use] = d[pole] + off
    vectors[:, use] = vectors[:, use] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """How many vectors, their mean, and the eigenvalues and eigenvectors of their scatter around it."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dim: int) -> Spectrum:
        return Spectrum(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray) -> None:
        """One more vector: its distance from the mean is added with weight n / (n + 1)."""
        apart = x - self.mean
        self.values, self.vectors = updated(self.values, self.vectors, apart, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + apart / self.n

    def join(self, other: Spectrum) -> None:
        """Adds what the other has seen: its eigenvectors one by one, and the distance of the means."""
        if not other.n:
            return
        apart = other.mean - self.mean
        total = self.n + other.n
        self.values, self.vectors = updated(self.values, self.vectors, apart, self.n / total * other.n)
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = updated(self.values, self.vectors, vector, value)
        self.mean = self.mean + apart * (other.n / total)
        self.n = total


_SPECTRUM = "n long, mean binary, eigenvalues binary, vectors binary"


def _packed(s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": pa.array([s.n]), "mean": [s.mean.tobytes()], "eigenvalues": [s.values.tobytes()], "vectors": [np.ascontiguousarray(s.vectors).tobytes()]})


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def tree(parts: DataFrame, ddl: str, add: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str, dim: int) -> pa.Table:
    """Adds up rows with dim x dim numbers, ``FAN_IN`` of them in a task, until so few are left that the driver adds the last."""
    parts, most = settle(parts, name), max(2, min(FAN_IN, FAN_BYTES // (8 * dim * dim)))
    while (n := parts.count()) > most:
        parts = settle(parts.repartition(-(-n // most)).mapInArrow(add, ddl), name)
    last = parts.toArrow()
    rows = list(add(iter(last.to_batches())))
    return pa.Table.from_batches(rows)


def numbers(docs: DataFrame, vector: str = "embedding") -> Column:
    """A vector's entries as whole numbers: null for null vectors and those with null or non-finite entries."""
    c = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.when(sound, F.transform(c, lambda e: F.floor(e * SCALE).cast("long")))


@dataclass(frozen=True)
class Whitening:
    """n different vectors, their sums, the components (rows) with eigenvalues and their parts of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def _moments(batches: Iterator[pa.RecordBatch], shift: np.ndarray, basis: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """Number, sums and products of the coordinates of shifted vectors in a basis."""
    n, first, second = 0, np.zeros(basis.shape[1]), np.zeros((basis.shape[1],) * 2)
    for batch in batches:
        y = (_matrix(batch.column("x"), dim) - shift) @ basis
        n, first, second = n + len(y), first + y.sum(0), second + y.T @ y
    if n:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "first": [first.tobytes()], "second": [second.tobytes()]})


def _covariance(vectors: DataFrame, shift: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) of vectors in a basis, centred before it is multiplied: ``shift`` is their mean."""
    dim, k = basis.shape
    held = vectors.sparkSession.sparkContext.broadcast((shift, basis))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for row in batch.to_pylist():
                n, first, second = n + row["n"], first + np.frombuffer(row["first"]), second + np.frombuffer(row["second"]).reshape(k, k)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "first": [first.tobytes()], "second": [second.tobytes()]})

    ddl = "n long, first binary, second binary"
    got = tree(vectors.mapInArrow(lambda b: _moments(b, *held.value, dim), ddl), ddl, add, "moments", k).to_pylist()[0]
    rest = np.frombuffer(got["first"]) / got["n"]  # what rounding leaves of the mean
    return np.frombuffer(got["second"]).reshape(k, k) / got["n"] - np.outer(rest, rest)


def spectrum(vectors: DataFrame, dim: int) -> Spectrum:
    """The spectrum of all rows of ``x``, by rank-one updates in tasks and a tree over them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(dim)
        for batch in batches:
            for x in _matrix(batch.column("x"), dim).astype(np.float64):
                own.add(x)
        if own.n:
            yield _packed(own)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(dim)
        for batch in batches:
            for r in batch.to_pylist():
                own.join(Spectrum(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["eigenvalues"]), np.frombuffer(r["vectors"]).reshape(dim, dim)))
        if own.n:
            yield _packed(own)

    r = tree(vectors.mapInArrow(read, _SPECTRUM), _SPECTRUM, add, "spectra", dim).to_pylist()[0]
    return Spectrum(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["eigenvalues"]), np.frombuffer(r["vectors"]).reshape(dim, dim))


def fit(rows: DataFrame, vector: str = "embedding", k: int = 4) -> Whitening | None:
    """Components of the different sound vectors; None if there are none.

    Vectors that repeat count once. Vectors without entries have no components; of vectors of
    several lengths the most frequent length counts, of equally frequent ones the smaller.
    Components whose eigenvalue is zero but for rounding have no direction and are left out,
    so a single vector, or equal ones, have none.
    """
    spark = rows.sparkSession
    ship(spark)
    every = settle(rows.select(numbers(rows, vector).alias("x")).where("size(x) > 0").distinct(), "vectors")
    lengths = every.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return None
    dim, n = lengths["dim"], lengths["count"]
    vectors = every.where(F.size("x") == dim)
    total = vectors.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    sums = [int(r["s"]) for r in total]
    mean = np.array([s / n for s in sums])
    basis = np.linalg.qr(spectrum(vectors, dim).vectors)[0]
    inner = _covariance(vectors, mean, basis)
    values, turned = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    trace = float(np.trace(inner))
    order = order[values[order] > dim * 16 * _EPS * max(trace, 0.0)]
    components = (basis @ turned[:, order]).T
    components /= np.sqrt((components * components).sum(1, keepdims=True))
    eigenvalues = values[order]
    if not len(order):
        return Whitening(n, sums, components, eigenvalues, eigenvalues, 0.0)
    white = _covariance(vectors, mean, components.T / np.sqrt(eigenvalues))
    return Whitening(n, sums, components, eigenvalues, eigenvalues / trace, float(np.abs(white - np.eye(len(order))).max()))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums of squares of n x - S, in whole numbers; null where they don't fit 64 bits."""
    most = max(n * max(int(x.max()), -int(x.min())), 1) + max(map(abs, sums)) if x.size else 0
    if most < 1 << 63 and most * most * x.shape[1] < 1 << 63:
        apart = n * x - np.array(sums, np.int64)
        return pa.array((apart * apart).sum(1))
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def whitened(rows: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """Rows with ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``, one for each component.

    Rows whose vector is null, has null or non-finite entries or another length than the
    components have none, as has every row if there are no components. Rows are independent:
    repeated ones give equal results. Other columns pass through, and ones named like the new
    ones are replaced; a ``deviation`` that 64 bits can't hold is null.
    """
    ship(rows.sparkSession)
    new = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = rows.drop(*(f.split()[0] for f in new.split(", ")))
    schema = extended(kept.drop(vector).schema if vector in kept.columns else kept.schema, new)
    if model is None or not len(model.components):
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    place = free_name(kept, "x")
    dim, k = len(model.sums), len(model.components)
    sound = kept.withColumn(place, numbers(kept, vector)).where(F.size(place) == dim).drop(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = shared.value
            x = _matrix(batch.column(place), dim)
            mean = np.array([s / held.n for s in held.sums])
            white = (x - mean) @ (held.components.T / np.sqrt(held.eigenvalues))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [c.take(each) for c, name in zip(batch.columns, batch.schema.names) if name != place]
            made = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), held.n)), _deviations(x, held.n, held.sums).take(each), pa.array(white.ravel()), pa.array(np.tile(held.explained, len(x))), pa.array(np.full(len(each), held.identity_error))]
            yield pa.RecordBatch.from_arrays([*columns, *made], schema.names)

    return sound.mapInArrow(run, schema)


def whitened_vectors(rows: DataFrame) -> DataFrame:
    """The four first whitened coordinates of each row of ``embeddings``."""
    own = rows.select("vec_id", "embedding")
    return whitened(own, fit(own)).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")

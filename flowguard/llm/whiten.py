"""Embedding whitening by incremental eigendecomposition.

Entries c become whole numbers x = floor(1024 c) + 100000. Every task keeps count, mean and the
eigendecomposition of the centred scatter of the rows it has seen, and takes in each row as a
centred rank-one update: the new eigenvalues are the roots of the secular equation, found by
rational interpolation between neighbouring poles and bisection where that leaves the bracket, after
deflating directions the update does not touch and equal eigenvalues; the new vectors follow from
the weights that belong exactly to the roots found, so they stay orthogonal. Spectra of tasks are
combined, ``FAN_IN`` at a time, by one rank-one update per eigenvector and one for the shift of the
means. The basis so found enters a Rayleigh-Ritz step over all rows, which gives the components to
double precision whatever rounding the many updates have left.

Means are exact: sums are whole numbers, and rows are centred on their whole part first. A deviation
that no long can hold is null.

Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those
with an entry of ``2**42`` and more in size, whose x is beyond what a double holds exactly, and those
with another length than most (ties: the longer). Zero vectors and repeated rows count like others; a
null id is kept. Directions without variance give no component, so equal rows, a single row or an
empty table give no rows. Equal eigenvalues: any basis of their space. Other columns are not looked at.
Memory: a batch of rows and a few square matrices of the vectors' length in each task and the driver,
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.ann import usual_length
from flowguard.llm.common import rows_batch, save

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 42)
FAN_IN = 4
EPS = np.finfo(np.float64).eps
PART = "part long, n long, body binary"
PART_SCHEMA = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
OUT_SQL = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")
OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                 ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z**2 / (d - x)) and the table d[i] - root[j]; d rises strictly, no z is 0."""
    m, weight = len(d), rho * z * z
    if m == 1:
        return d + weight, -weight[:, None]
    gap = np.append(np.diff(d), weight.sum())
    # Each root is found as a distance from the nearer of its two poles.
    middle = d + gap / 2
    left = 1 + (weight[:, None] / (d[:, None] - middle)).sum(axis=0) >= 0
    left[-1] = True
    origin = np.where(left, d, np.append(d[1:], d[-1]))
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1] * (1 + 4 * EPS)
    offset = d[:, None] - origin
    place = np.arange(m)
    first, second = np.minimum(place, m - 2), np.minimum(place + 1, m - 1)  # the poles to interpolate
    below = place[:, None] <= first
    x = (low + high) / 2
    for _ in range(90):
        delta = offset - x
        part = weight[:, None] / delta
        f = 1 + part.sum(axis=0)
        done = np.abs(f) <= EPS * m * (1 + np.abs(part).sum(axis=0))
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        done |= high - low <= 2 * EPS * np.abs(x)
        if done.all():
            break
        slope = part / delta
        psi = np.where(below, slope, 0).sum(axis=0)
        phi = slope.sum(axis=0) - psi
        one, two = delta[first, place], delta[second, place]
        c = f - one * psi - two * phi
        a = (one + two) * f - one * two * (psi + phi)
        b = one * two * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        root[-1] = -root[-1]  # the last root lies right of both of its poles
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where((a <= 0) == (place < m - 1), (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        inside = (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return origin + x, offset - x


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, v: np.ndarray):
    """Eigenvalues (rising) and vectors of ``vectors diag(values) vectors' + rho v v'``, rho > 0."""
    z = vectors.T @ v
    size = float(np.sqrt(z @ z))
    if rho * size * size <= 0:
        return values, vectors
    small = 8 * EPS * max(float(values[-1]), rho * size * size)
    # Equal eigenvalues: turn their space so that the update touches one of its directions only.
    equal = np.diff(values) <= small
    if equal.any():
        vectors = vectors.copy()
        s = 0
        while s < len(values):
            e = s + 1
            while e < len(values) and values[e] - values[s] <= small:
                e += 1
            if e - s > 1:
                norm = np.sqrt(z[s:e] @ z[s:e])
                mirror = z[s:e].copy()
                mirror[-1] += np.copysign(norm, mirror[-1])
                length = mirror @ mirror
                if length > 0:
                    vectors[:, s:e] -= np.outer(vectors[:, s:e] @ mirror, mirror) * (2 / length)
                    z[s:e - 1], z[e - 1] = 0.0, -np.copysign(norm, z[e - 1])
            s = e
    live = np.flatnonzero(rho * size * np.abs(z) > small)
    if not len(live):
        return values, vectors
    d, zl = values[live], z[live]
    if len(live) > 1 and not (np.diff(d) > 0).all():  # told apart by less than a double holds
        d = np.maximum.accumulate(d + np.arange(len(d)) * EPS * abs(d[-1]))
    roots, delta = secular(d, zl, rho)
    m = len(d)
    # Weights for which the roots are exact; with them the vectors are orthogonal.
    ratio = -delta
    if m > 1:
        apart = d - d[:, None]
        j = np.arange(m)
        np.fill_diagonal(apart, 1.0)
        lower = j[:, None] > j
        under = np.where(lower, apart, np.concatenate([apart[:, 1:], np.ones((m, 1))], axis=1))
        under[np.arange(m - 1), np.arange(m - 1)] = d[1:] - d[:-1]
        ratio = ratio / under
    weight = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1))), zl)
    turn = weight[:, None] / delta
    turn /= np.sqrt((turn * turn).sum(axis=0))
    new = vectors.copy()
    new[:, live] = vectors[:, live] @ turn
    values = values.copy()
    values[live] = roots
    order = np.argsort(values, kind="stable")
    return values[order], new[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the centred scatter of some rows."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def add(self, row: np.ndarray) -> None:
        apart = row - self.mean
        if self.n and apart.any():
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n / (self.n + 1), apart)
        self.n += 1
        self.mean = self.mean + apart / self.n

    def merge(self, other: Spectrum) -> None:
        """Take in the rows of another spectrum, one rank-one update per eigenvector."""
        if not other.n:
            return
        for value, vector in zip(other.values[::-1], other.vectors.T[::-1]):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, float(value), vector)
        apart, n = other.mean - self.mean, self.n + other.n
        if self.n and apart.any():
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / n, apart)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n

    def body(self) -> bytes:
        return np.concatenate([self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def of(cls, n: int, body: bytes, width: int) -> Spectrum:
        out, flat = cls(width), np.frombuffer(body)
        out.n, out.mean, out.values = n, flat[:width].copy(), flat[width:2 * width].copy()
        out.vectors = flat[2 * width:].reshape(width, width).copy()
        return out


def whole(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """x of the rows of a batch."""
    c = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * c).astype(np.int64) + SHIFT).reshape(-1, width)


def fold(parts: DataFrame, merge: Callable[[list[tuple[int, bytes]]], tuple[int, bytes]]) -> tuple[int, bytes] | None:
    """One (n, body) from those of all tasks, ``FAN_IN`` at a time on the executors."""
    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        n, body = merge([(r["n"], r["body"]) for r in rows])
        return pa.table({"part": [rows[0]["part"] // FAN_IN], "n": [n], "body": [body]}, schema=PART_SCHEMA)

    parts = save(parts, "parts")
    while (last := parts.agg(F.max("part")).first()[0]) is not None and last > 0:
        group = F.floor(F.col("part") / FAN_IN)
        parts = save(parts.groupBy(group).applyInArrow(work, PART), "parts")
    first = parts.first()
    return first and (first["n"], bytes(first["body"]))


def add_up(rows: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    return sum(n for n, _ in rows), sum(np.frombuffer(b) for _, b in rows).tobytes()


class Whitening:
    """Components of a table of vectors, fitted on all its valid rows."""

    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8):
        fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
        found = (rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))
                 .where(F.col("vec").isNotNull() & (F.size("vec") > 0) & fine))
        self.width, self.n = usual_length(found)
        self.rows = found.where(F.size("vec") == self.width)
        self.values = np.zeros(0)
        if not self.n:
            return
        self.sums = self._sums()
        split = [divmod(s, self.n) for s in self.sums]
        self.center = np.array([q for q, _ in split], np.int64)
        self.rest = [r for _, r in split]
        self.fraction = np.array([r / self.n for r in self.rest])
        basis = np.linalg.qr(self._basis())[0]
        scatter = self._scatter(basis)
        values, turn = np.linalg.eigh((scatter + scatter.T) / 2)
        self.trace = float(np.trace(scatter))
        values, vectors = values[::-1], (basis @ turn)[:, ::-1]
        count = min(components, int((values > 16 * self.width * EPS * values[0]).sum())) if values[0] > 0 else 0
        self.values, self.vectors = values[:count], np.ascontiguousarray(vectors[:, :count])
        if count:
            moment = self._scatter(self.vectors / np.sqrt(self.values))
            self.identity_error = float(np.abs(moment - np.eye(count)).max())

    def _sums(self) -> list[int]:
        """Exact sum of x in each dimension."""
        width = self.width

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            high, low = [0] * width, [0] * width
            for batch in batches:
                x = whole(batch, width)
                high = [a + int(b) for a, b in zip(high, (x >> 26).sum(axis=0))]
                low = [a + int(b) for a, b in zip(low, (x & ((1 << 26) - 1)).sum(axis=0))]
            total = [(h << 26) + s for h, s in zip(high, low)]
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(width), pa.int32()),
                                              "total": pa.array([str(t) for t in total])})
        sums = (self.rows.select("vec").mapInArrow(work, "k int, total string").groupBy("k")
                .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
        return [int(r["total"]) for r in sorted(sums, key=lambda r: r["k"])]

    def _centred(self):
        width, center, fraction = self.width, self.center, self.fraction
        return lambda batch: (whole(batch, width) - center).astype(np.float64) - fraction

    def _basis(self) -> np.ndarray:
        """Eigenvectors found by updates of all rows, task by task, and merged."""
        width, centred = self.width, self._centred()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spectrum = Spectrum(width)
            for batch in batches:
                for row in centred(batch):
                    spectrum.add(row)
            if spectrum.n:
                yield rows_batch({"part": [TaskContext.get().partitionId()], "n": [spectrum.n],
                                  "body": [spectrum.body()]}, PART_SCHEMA)

        def merge(rows: list[tuple[int, bytes]]) -> tuple[int, bytes]:
            out = Spectrum.of(*rows[0], width)
            for n, body in rows[1:]:
                out.merge(Spectrum.of(n, body, width))
            return out.n, out.body()
        n, body = fold(self.rows.select("vec").mapInArrow(work, PART), merge)
        return Spectrum.of(n, body, width).vectors

    def _scatter(self, basis: np.ndarray) -> np.ndarray:
        """Covariance of all rows in the given directions."""
        centred, size = self._centred(), basis.shape[1]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros((size, size))
            for batch in batches:
                y = centred(batch) @ basis
                n, total = n + len(y), total + y.T @ y
            if n:
                yield rows_batch({"part": [TaskContext.get().partitionId()], "n": [n],
                                  "body": [total.tobytes()]}, PART_SCHEMA)
        _, body = fold(self.rows.select("vec").mapInArrow(work, PART), add_up)
        return np.frombuffer(body).reshape(size, size) / self.n

    def apply(self) -> DataFrame:
        """A row for each valid vector and component."""
        if not len(self.values):
            return self.rows.sparkSession.createDataFrame([], OUT_SQL)
        width, n, center, rest, fraction = self.width, self.n, self.center, self.rest, self.fraction
        turn, count, error = self.vectors / np.sqrt(self.values), len(self.values), self.identity_error
        explained = self.values / self.trace

        def deviations(x: np.ndarray) -> list:
            """Sum of (n x - S)**2 over the dimensions, in whole numbers of any size."""
            y = x - center
            most = n * (int(np.abs(y).max()) + 1)
            if most * most * width < 1 << 63:
                t = y * n - np.array(rest, np.int64)
                return (t * t).sum(axis=1).tolist()
            exact = (y.astype(object) * n - np.array(rest, object)) ** 2
            return [int(s) if s < 1 << 63 else None for s in exact.sum(axis=1)]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = whole(batch, width)
                z = ((x - center).astype(np.float64) - fraction) @ turn
                many = len(x) * count
                rows = pa.array(np.repeat(np.arange(len(x)), count))
                yield rows_batch({
                    "vec_id": batch.column("id").take(rows),
                    "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)),
                    "n": np.full(many, n), "deviation": pa.array(deviations(x), pa.int64()).take(rows),
                    "whitened": z.ravel(), "explained": np.tile(explained, len(x)),
                    "identity_error": np.full(many, error)}, OUT)
        return self.rows.mapInArrow(work, OUT_SQL)


def whiten(rows: DataFrame, **options) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    return Whitening(rows, **options).apply()

"""Whitening of embeddings by the leading components of their covariance, found by slicing its spectrum.

Spark sums the vectors and, once the means are known, the products of the centred ones; both sums are exact
whole numbers, so neither the order of tasks nor a task that runs again changes them. What reaches the driver has the
size of one covariance. There the factorisation V - s I = L D Lt tells how many eigenvalues stand above s: the signs of
D are those of the shifted eigenvalues (inertia). Bisection by these counts puts each leading eigenvalue
in an interval of its own; Rayleigh quotient iteration from there converges cubically; and the counts on both
sides of what it found certify the number. Eigenvalues that double precision can't tell apart share an interval and
get an orthonormal basis of their space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, plainly, stash

#: Entries become whole numbers by this factor; a row with an entry beyond LARGEST after it has no such number.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**61
#: A sum travels as two longs, high * 2**HIGH + low.
HIGH = 62
#: Vectors multiplied at once.
CHUNK = 4096

EPS = float(np.finfo(np.float64).eps)


class Factors:
    """L D Lt of a symmetric matrix, with the pivots of Bunch and Kaufman (blocks of one or two rows)."""

    def __init__(self, matrix: np.ndarray):
        a = np.array(matrix, np.float64)
        n = len(a)
        self.order, self.lower, self.blocks = np.arange(n), np.eye(n), []
        self.tiny = EPS * (np.abs(a).max() if n else 0.0) or 1e-300
        k, alpha = 0, (1 + 17**0.5) / 8
        while k < n:
            size = 1
            if k < n - 1:
                r = k + 1 + int(np.argmax(np.abs(a[k + 1 :, k])))
                most, own = abs(a[r, k]), abs(a[k, k])
                if own < alpha * most:
                    row = np.abs(a[r, k:])
                    row[r - k] = 0
                    beside = row.max()
                    if own * beside < alpha * most * most:
                        if abs(a[r, r]) >= alpha * beside:
                            self._swap(a, k, r)
                        else:
                            self._swap(a, k + 1, r)
                            size = 2
            block, rest = a[k : k + size, k : k + size].copy(), slice(k + size, n)
            if size == 1 and abs(block[0, 0]) < self.tiny * 1e-3:
                block[0, 0] = self.tiny * (1e-3 if block[0, 0] >= 0 else -1e-3)  # the shift is an eigenvalue to the last bit
            self.blocks.append((k, block))
            side = a[rest, k : k + size]
            l = side / block[0, 0] if size == 1 else side @ np.linalg.inv(block)
            self.lower[rest, k : k + size] = l
            a[rest, rest] -= l @ side.T
            k += size

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.lower[[i, j], :i] = self.lower[[j, i], :i]
            self.order[[i, j]] = self.order[[j, i]]

    def positive(self) -> int:
        """How many eigenvalues are above 0."""
        return sum(int(b[0, 0] > 0) if len(b) == 1 else 1 if np.linalg.det(b) < 0 else 2 * int(b[0, 0] > 0) for _, b in self.blocks)

    def solve(self, right: np.ndarray) -> np.ndarray:
        x = np.array(right, np.float64)[self.order]
        n = len(x)
        for k in range(n):
            x[k + 1 :] -= np.multiply.outer(self.lower[k + 1 :, k], x[k]) if x.ndim > 1 else self.lower[k + 1 :, k] * x[k]
        for k, b in self.blocks:
            x[k : k + len(b)] = x[k] / b[0, 0] if len(b) == 1 else np.linalg.solve(b, x[k : k + 2])
        for k in range(n - 1, -1, -1):
            x[k] -= self.lower[k + 1 :, k] @ x[k + 1 :]
        out = np.empty_like(x)
        out[self.order] = x
        return out


class Spectrum:
    """Leading eigenvalues and unit eigenvectors of a symmetric matrix, given as a sum of a high and a low part."""

    def __init__(self, high: np.ndarray, low: np.ndarray | None = None):
        self.v, self.d = high, len(high)
        self.exact = high.astype(np.longdouble) + (0 if low is None else low)
        radius = np.abs(high).sum(axis=1)
        self.norm = float(radius.max()) if self.d else 0.0
        self.close = 16 * EPS * self.norm
        reach = self.norm * (1 + 1e-9) + 1e-300
        #: (shift, eigenvalues above it), by rising shift: what is known so far.
        self.slices = [(-reach, self.d), (reach, 0)]
        self.factorisations = 0

    def shifted(self, shift: float) -> Factors:
        self.factorisations += 1
        return Factors(self.v - shift * np.eye(self.d))

    def above(self, shift: float) -> int:
        for at, n in self.slices:
            if at == shift:
                return n
        n = self.shifted(shift).positive()
        self.slices = sorted([*self.slices, (shift, n)])
        return n

    def isolated(self, number: int) -> tuple[float, float]:
        """An interval that holds the eigenvalue of this number, from 1, alone, or is too narrow to be cut."""
        low, high = max(s for s in self.slices if s[1] >= number), min(s for s in self.slices if s[1] < number)
        while (low[1], high[1]) != (number, number - 1) and high[0] - low[0] > self.close:
            low, high = self._cut(number, low, high)
        return low[0], high[0]

    def _cut(self, number: int, low: tuple, high: tuple) -> tuple[tuple, tuple]:
        middle = (low[0] + high[0]) / 2
        n = self.above(middle)
        return ((middle, n), high) if n >= number else (low, (middle, n))

    def leading(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Values, falling, and their vectors as columns; each vector's largest entry is positive."""
        values, vectors = [], np.zeros((self.d, 0))
        wanted = min(wanted, self.d)
        if not self.norm:
            return np.zeros(wanted), np.eye(self.d)[:, :wanted]
        while len(values) < wanted:
            number = len(values) + 1
            low, high = self.isolated(number)
            found = self._single(number, low, high, vectors)
            if found is None:
                low, high = self.slices_around(number)
                found = self._cluster(low, high, vectors)
            values += list(found[0])
            vectors = np.column_stack([vectors, found[1]])
        values, vectors = np.array(values[:wanted]), vectors[:, :wanted]
        return values, vectors * np.where(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(wanted)] < 0, -1.0, 1.0)

    def slices_around(self, number: int) -> tuple[float, float]:
        """An interval around an eigenvalue whose ends keep ten times the rounding off every eigenvalue that they count."""
        low, high = self.isolated(number)
        while high - low > self.close:
            a, b = self._cut(number, (low, self.above(low)), (high, self.above(high)))
            low, high = a[0], b[0]
        return low - 10 * self.close, high + 10 * self.close

    def _single(self, number: int, low: float, high: float, before: np.ndarray):
        """By Rayleigh quotients inside the interval; None if the counts don't certify the number."""
        start = np.random.default_rng(number).standard_normal(self.d)
        while high - low > self.close and (self.above(low), self.above(high)) == (number, number - 1):
            x, shift, last = self._unit(start - before @ (before.T @ start)), (low + high) / 2, np.inf
            for _ in range(12):
                x = self._unit(self.shifted(shift).solve(x))
                shift = float(x @ (self.v @ x))
                off = float(np.linalg.norm(self.v @ x - shift * x))
                if not low < shift < high or off <= 4 * EPS * self.norm or off >= last and off < 1e-9 * self.norm:
                    break
                last = off
            if low < shift < high and off < 1e-9 * self.norm:
                value, x = self._refined(x)
                apart = 8 * EPS * self.norm * max(1.0, self.d**0.5 / 8)
                certified = self.above(value - apart) == number and self.above(value + apart) == number - 1
                return ([value], x[:, None]) if certified else None
            a, b = self._cut(number, (low, number), (high, number - 1))
            low, high = a[0], b[0]
        return None

    def _refined(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Corrections of value and vector from residuals in longer numbers; a correction that doesn't shrink is not made."""
        wide, last = x.astype(np.longdouble), np.inf
        wide /= np.sqrt(wide @ wide)
        for _ in range(4):
            value = wide @ (self.exact @ wide)
            off = self.exact @ wide - value * wide
            bordered = np.zeros((self.d + 1, self.d + 1))
            bordered[:-1, :-1] = self.v - float(value) * np.eye(self.d)
            bordered[:-1, -1] = bordered[-1, :-1] = wide.astype(np.float64) * self.norm
            step = Factors(bordered).solve(np.r_[-off.astype(np.float64), 0.0])[:-1]
            size = float(np.linalg.norm(step))
            if not size < last / 2 or size > 0.1:
                break
            wide, last = wide + step, size
            wide /= np.sqrt(wide @ wide)
        return float(wide @ (self.exact @ wide)), wide.astype(np.float64)

    def _cluster(self, low: float, high: float, before: np.ndarray):
        """Values and an orthonormal basis for all eigenvalues between, which are equal to rounding."""
        n = self.above(low) - self.above(high)
        x = np.random.default_rng(self.d).standard_normal((self.d, n))
        inverse = self.shifted((low + high) / 2)
        for _ in range(6):
            x = np.linalg.qr(x - before @ (before.T @ x))[0]
            x = inverse.solve(x)
            x /= np.abs(x).max(axis=0)
        for _ in range(2):
            x = np.linalg.qr(x - before @ (before.T @ x))[0]
        values, turn = np.linalg.eigh(x.T @ self.v @ x)
        return values[::-1], (x @ turn)[:, ::-1]

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)


@dataclass(frozen=True)
class Whitening:
    """What the fit knows: rows, sums of whole-number entries less the means, and the components."""

    n: int
    means: list[int]  # rounded, of x
    left: list[int]  # sums of x less n times the rounded means
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dimensions(self) -> int:
        return len(self.means)

    @property
    def varied(self) -> list[bool]:
        """Which components have variance, beyond rounding."""
        return [bool(e > 8 * EPS * max(1, self.dimensions) * self.trace) for e in self.values]


def _halves(numbers: np.ndarray) -> list[pa.Array]:
    """High and low longs of whole numbers of any size."""
    if numbers.dtype == object:
        return [pa.array([int(v) >> HIGH for v in numbers], pa.int64()), pa.array([int(v) & ((1 << HIGH) - 1) for v in numbers], pa.int64())]
    return [pa.array(numbers >> HIGH), pa.array(numbers & ((1 << HIGH) - 1))]


def _whole(high, low) -> int:
    return (int(high) << HIGH) + int(low)


def whole_vectors(table: DataFrame, vector: str) -> DataFrame:
    """``table`` with ``_x``, the whole numbers floor(1024 c) + 100000, without rows whose vector is null, empty, or has an entry that is null, not finite or too large for one."""
    c = lambda e: e.cast("double")
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(c(e)) & (F.abs(c(e)) < LARGEST / SCALE)), F.lit(False))
    return table.where(usable).withColumn("_x", F.transform(vector, lambda e: F.floor(SCALE * c(e)) + OFFSET))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows of the commonest length (of several the longest), and their sums by dimension."""

    def scan(batches):
        held: dict[int, list] = {}
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            for d in np.unique(lengths):
                x = _matrix(batch.column(0).filter(pa.array(lengths == d)))
                wide = np.abs(x).max() > 1 << 40
                total = held.setdefault(int(d), [0, np.zeros(d, object)])
                total[0] += len(x)
                total[1] = total[1] + (x.astype(object) if wide else x).sum(axis=0).astype(object)
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), *_halves(sums)], ["d", "i", "n", "high", "low"])

    parts = rows.select("_x").mapInArrow(scan, "d int, i int, n long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = stash(parts.groupBy("d", "i").agg(F.sum("n").alias("n"), total("high"), total("low")), "vector-sums")
    most = found.where("i = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not most:
        return 0, []
    return most[0].n, [_whole(r.high, r.low) for r in found.where(F.col("d") == most[0].d).orderBy("i").collect()]


def _products(rows: DataFrame, means: list[int]) -> np.ndarray:
    """Sums of the products of centred entries, as whole numbers; the upper triangle of a symmetric matrix."""
    d, at = len(means), np.triu_indices(len(means))

    def scan(batches):
        centre, total, any_row = np.array(means, np.int64), np.zeros(len(at[0]), object), False
        for batch in batches:
            x = _matrix(batch.column(0))
            for k in range(0, len(x), CHUNK):
                z = x[k : k + CHUNK] - centre
                most = float(np.abs(z).max()) ** 2 * len(z)
                kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object  # each is exact
                z = z.astype(kind)
                g = (z.T @ z)[at]
                total = total + (g if kind is object else g.astype(np.int64).astype(object))
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), *_halves(total)], ["i", "j", "high", "low"])

    parts = rows.select("_x").mapInArrow(scan, "i int, j int, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = np.zeros((d, d), object)
    for r in parts.groupBy("i", "j").agg(total("high"), total("low")).collect():
        out[r.i, r.j] = out[r.j, r.i] = _whole(r.high, r.low)
    return out


def _divided(numbers: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotients as the nearest doubles, and what these are off."""
    high, low = np.zeros(numbers.shape), np.zeros(numbers.shape)
    for i, v in np.ndenumerate(numbers):
        high[i] = int(v) / by
        a, b = float(high[i]).as_integer_ratio()
        low[i] = (int(v) * b - a * by) / (by * b)
    return high, low


def fit(rows: DataFrame, components: int = 8) -> tuple[DataFrame, Whitening | None]:
    """The rows (with ``_x``) of the commonest length and their whitening; None without rows."""
    n, sums = _sums(rows)
    if not n:
        return rows, None
    rows = rows.where(F.size("_x") == len(sums))
    means = [(2 * s + n) // (2 * n) for s in sums]
    left = [s - n * m for s, m in zip(sums, means, strict=True)]
    products = _products(rows, means)
    rest = np.array(left, object)
    scaled = n * products - np.multiply.outer(rest, rest)
    values, vectors = Spectrum(*_divided(scaled, n * n)).leading(components)
    return rows, Whitening(n, means, left, values, vectors, int(sum(scaled[i, i] for i in range(len(sums)))) / (n * n))


def _projected(rows: DataFrame, own: str, w: Whitening) -> DataFrame:
    """id, high and low (of the sum of squares of n x - S), and the whitened components of each row."""
    varied, n = w.varied, w.n
    axes = w.vectors / np.sqrt(np.where(varied, w.values, 1.0))

    def scan(batches):
        centre, rest = np.array(w.means, np.int64), np.array(w.left, object)
        off = np.array([r / n for r in w.left])
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _matrix(batch.column(1)) - centre
            most = float(n) * (float(np.abs(z).max()) + 1)
            whole = z * np.int64(n) - rest.astype(np.int64) if most * most * z.shape[1] < 2**62 else z.astype(object) * n - rest
            white = ((z.astype(np.float64) - off) @ axes).astype(np.float64)
            kept = np.broadcast_to(np.array(varied), white.shape).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel(), pa.float64(), mask=~kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_halves((whole * whole).sum(axis=1)), lists], ["id", "high", "low", "white"])

    kind = rows.schema[own].dataType.simpleString()
    return rows.select(own, "_x").mapInArrow(scan, f"id {kind}, high long, low long, white array<double>")


def _identity_error(projected: DataFrame, varied: list[bool]) -> float | None:
    """Largest absolute entry of the covariance of the whitened components that vary, less the identity."""
    kept = [i for i, v in enumerate(varied) if v]
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    if not pairs:
        return None
    wide = projected.select(*(F.col("white")[i].alias(f"w{i}") for i in kept))
    row = wide.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(table: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    All usable vectors are the fit: those that are not null or empty and whose entries are all finite, of the commonest
    length (of several the longest); others are left out. ``deviation`` is the exact squared distance to the mean times
    n squared, a decimal. There are at most as many components as dimensions. A component without variance (equal rows, a single row,
    dependent dimensions) has a null ``whitened``; ``explained`` is null where no component has any, and so is ``identity_error``.
    Rows with equal or null ids are rows like others; an empty table gives no rows.
    """
    plain, (own, vector) = plainly(table, id_col, vector_col)
    bounded_batches(table.sparkSession)
    rows, w = fit(whole_vectors(plain.select(own, vector), vector).select(own, "_x"), components)
    kind = plain.schema[own].dataType.simpleString()
    if w is None:
        return table.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    projected = stash(_projected(rows, own, w), "whitened")
    error = _identity_error(projected, w.varied)
    shares = [max(0.0, float(e)) / w.trace if w.trace else None for e in w.values]
    deviation = F.try_add(F.try_multiply(F.col("high").cast("decimal(18,0)"), F.lit(1 << HIGH).cast("decimal(19,0)")), F.col("low").cast("decimal(19,0)"))
    each = projected.select("id", deviation.cast("decimal(38,0)").alias("deviation"), F.posexplode("white").alias("_c", "whitened"))
    share = F.get(F.array(*(F.lit(s).cast("double") for s in shares)), F.col("_c"))
    return each.select(
        F.col("id").alias(id_col), (F.col("_c") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All usable embeddings on eight components; a deviation beyond a long is null."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").try_cast("long"))

"""Embedding whitening with a covariance by polarisation.

Entries become whole numbers x = floor(64 c) + 1000000, so every sum is exact.

1. One pass counts the vectors and sums every dimension (``n``, ``S``).
2. A second pass sums the squares of the centred values of every dimension and
   of the sum of every two dimensions: with y = x - floor(S / n), which is small
   and whole, n sum(y^2) - (S - n floor(S / n))^2 is n^2 times the variance.
   Tasks keep one total per dimension or pair, never products of raw values.
3. Cov(i, j) = (Var(i + j) - Var(i) - Var(j)) / 2, in whole numbers until one
   last division.  The matrix (dimensions by dimensions, whatever the number
   of rows) goes to ``eigh`` on the driver.
4. A third pass measures the whitened values' own covariance, a fourth returns
   them.

Only matrices whose size depends on the dimensions leave the tasks.

Defined results: vectors that are null or hold null or non-finite entries take
no part; neither do vectors whose length is not the most frequent one (of
equally frequent ones the longest), nor empty ones.  Repeated rows and null ids
count as rows of their own.  Entries beyond 2^55 in size count as 2^55.
Components without variance have a null ``whitened`` and take no part in
``identity_error``; ``deviation`` is null where it exceeds a long.  An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelink.llm.common import bound_batches, materialise

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0 ** 55      # entries are held within this
COMPONENTS = 32
FLAT = 1e-12             # of the trace: eigenvalues up to here are no variance
PART_ROWS = 512          # vectors worked on at a time
_LIMB, _LIMBS = 40, 4    # exact sums travel as four numbers of 40 bits


def _limbs(value: int) -> list[int]:
    parts = [(value >> (_LIMB * i)) & ((1 << _LIMB) - 1) for i in range(_LIMBS - 1)]
    return [*parts, value >> (_LIMB * (_LIMBS - 1))]


def _value(row) -> int:
    return sum(int(row[f"l{i}"]) << (_LIMB * i) for i in range(_LIMBS))


_LIMB_SCHEMA = ", ".join(f"l{i} long" for i in range(_LIMBS))


def _totals(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """``a, b`` and the limbs of a sum."""
    flat = [(a, b, *_limbs(v)) for a, b, v in rows]
    names = ["a", "b", *(f"l{i}" for i in range(_LIMBS))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*flat) if flat else [[]] * len(names))], names=names)


def _added(partials: DataFrame, name: str) -> DataFrame:
    return materialise(partials.groupBy("a", "b").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(_LIMBS)]), name)


def whole_numbers(vectors: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``vectors`` that take part and have ``dim`` entries, and their entries x."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    entries = flat.reshape(len(rows), dim)  # a null entry is a NaN here
    good = np.isfinite(entries).all(axis=1)
    entries = np.clip(entries[good], -LARGEST, LARGEST)
    return rows[good], np.floor(SCALE * entries).astype(np.int64) + SHIFT


def _exact(values: np.ndarray, bound: int) -> np.ndarray:
    """The values, as Python numbers where a result may reach ``bound`` and that is over a long."""
    return values if bound < 1 << 63 else values.astype(object)


def _size(values: np.ndarray) -> int:
    return max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))


def _count_and_sum(batches):
    """Per length: number of vectors (``b`` -1) and sum of every dimension."""
    counts: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column(0)
        for dim in np.unique(vectors.value_lengths().drop_null().to_numpy()).tolist():
            if dim == 0:
                continue
            _, x = whole_numbers(vectors, dim)
            if len(x):
                counts[dim] = counts.get(dim, 0) + len(x)
                sums[dim] = sums.get(dim, 0) + _exact(x, _size(x) * len(x)).sum(axis=0).astype(object)
    for dim, n in counts.items():
        yield _totals([(dim, -1, n), *((dim, i, s) for i, s in enumerate(sums[dim]))])


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Sums of the squares of y_i (first of each run) and of y_i + y_j for j > i, as Python numbers."""
    y = _exact(y, 4 * _size(y) ** 2 * max(1, len(y)))
    found = []
    for i in range(y.shape[1]):
        t = y[:, i:] + y[:, i:i + 1]
        t[:, 0] = y[:, i]
        found.append((t * t).sum(axis=0) if y.dtype == object else np.einsum("rk,rk->k", t, t))
    return np.concatenate(found).astype(object)


@dataclass
class Whitening:
    """A fitted model; everything in it is sized by the dimensions."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray   # a column each
    trace: float
    keep: int                # components returned

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S / n as small whole numbers and a fraction to take off them."""
        base = [s // self.n for s in self.sums]
        return x - np.array(base, dtype=np.int64), np.array([(s - self.n * b) / self.n for s, b in zip(self.sums, base)])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whitened values, NaN for components without variance."""
        y, rest = self.centred(x)
        e = self.eigenvalues[:self.keep]
        scale = np.where(e > FLAT * self.trace, e, np.nan)
        return ((y - rest) @ self.components[:, :self.keep]) / np.sqrt(scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n x - S)^2; None where a long is too short."""
        y, _ = self.centred(x)
        rest = [s - self.n * (s // self.n) for s in self.sums]
        bound = (self.n * (_size(y) + 1)) ** 2 * y.shape[1]
        off = _exact(y, bound) * self.n - np.array(rest, dtype=object if bound >= 1 << 63 else np.int64)
        return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]


def fit(rows: DataFrame, vector_col: str, keep: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors that take part; None if there are none."""
    schema = f"a long, b long, {_LIMB_SCHEMA}"
    vectors = rows.select(vector_col)
    first = _added(vectors.mapInArrow(_count_and_sum, schema), "whitening-sums")
    # At most one row for every length that occurs; the driver takes one of them.
    top = (first.filter("b = -1").orderBy(*[F.desc(f"l{i}") for i in reversed(range(_LIMBS))], F.desc("a")).limit(1).collect())
    if not top:
        return None
    n, dim = _value(top[0]), int(top[0]["a"])
    sums = [0] * dim
    for row in first.filter((F.col("a") == dim) & (F.col("b") >= 0)).collect():
        sums[row["b"]] = _value(row)
    base = np.array([s // n for s in sums], dtype=np.int64)
    place = [(i, j) for i in range(dim) for j in range(i, dim)]

    def squares(batches):
        total = None
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dim)
            for at in range(0, len(x), PART_ROWS):
                part = pair_squares(x[at:at + PART_ROWS] - base)
                total = part if total is None else total + part
        if total is not None:
            yield _totals([(i, j, v) for (i, j), v in zip(place, total)])

    square = {(r["a"], r["b"]): _value(r) for r in _added(vectors.mapInArrow(squares, schema), "whitening-squares").collect()}
    rest = [s - n * int(b) for s, b in zip(sums, base)]
    # n^2 times the variance of a dimension, and of the sum of two.
    own = [n * square[i, i] - rest[i] ** 2 for i in range(dim)]
    v = np.empty((dim, dim))
    for i, j in place:
        both = own[i] if i == j else (n * square[i, j] - (rest[i] + rest[j]) ** 2 - own[i] - own[j])
        v[i, j] = v[j, i] = both / ((n * n) if i == j else (2 * n * n))
    e, p = np.linalg.eigh(v)
    e, p = e[::-1], p[:, ::-1]
    p = p * np.where(p[np.abs(p).argmax(axis=0), np.arange(dim)] < 0, -1.0, 1.0)  # one sign for all rows and runs
    return Whitening(n, sums, e, p, sum(own) / (n * n), min(keep, dim))


def identity_error(rows: DataFrame, vector_col: str, model: Whitening) -> float | None:
    """Largest entry of the whitened values' covariance less the identity, measured over all vectors."""
    alive = np.flatnonzero(model.eigenvalues[:model.keep] > FLAT * model.trace)
    if not len(alive):
        return None
    dim, k = len(model.sums), len(alive)
    names = ["a", "b", "v"]

    def products(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dim)
            w = model.whiten(x)[:, alive]
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        a, b = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int64()), pa.array(b.ravel(), pa.int64()),
                                          pa.array(total.ravel(), pa.float64())], names=names)

    found = rows.select(vector_col).mapInArrow(products, "a long, b long, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    total = np.zeros((k + 1, k))
    for r in found.collect():  # (k + 1) * k sums
        total[r["a"], r["b"]] = r["v"]
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per vector and component."""
    bound_batches(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    model = fit(rows, vector_col, keep)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, vector_col, model)
    dim, k = len(model.sums), model.keep
    explained = model.eigenvalues[:k] / model.trace if model.trace else np.full(k, np.nan)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                taken, x = whole_numbers(part.column(1), dim)
                w = model.whiten(x).ravel()
                share = np.tile(explained, len(taken))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(taken, k))), pa.array(np.tile(np.arange(1, k + 1), len(taken)), pa.int32()),
                    pa.array(np.full(len(w), model.n), pa.int64()),
                    pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(w, mask=np.isnan(w)), pa.array(share, mask=np.isnan(share)),
                    pa.array([error] * len(w), pa.float64())], names=names)

    return rows.select(id_col, vector_col).mapInArrow(run, schema)

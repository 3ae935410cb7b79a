"""Whitening of embeddings by their leading principal components.

Rows whose vector is null or holds null or non-finite entries are left out. Every entry c becomes the whole number ``floor(256 * c)``. The model is
fitted on the fit list, each distinct whole-number vector once: n vectors, sums S, covariance V (divisor n).

Covariance. A first pass gives n and S. A second one centres every vector at the whole numbers m nearest to S / n and sums the products of the
centred entries; as whole numbers these sums are exact, whatever the order and number of tasks, and what is left of the
centre (under 1/2 an entry) is taken off exactly before the one division. So V is right to the last bit or two, and reruns agree.

Eigenvectors. Householder reflections make V tridiagonal. Bisection on Sturm counts (how many eigenvalues lie below a number)
finds the leading eigenvalues, inverse iteration on the tridiagonal matrix their vectors, and vectors of eigenvalues in one cluster (closer than
1e-3 of the norm) are reorthogonalised against each other in every step; the reflections carry them back. The matrix is as large as a vector is long, so this is driver work
of a bounded size, whatever the number of rows.

Projection. The model (a few vectors) goes to every task; a pass over all rows writes the whitened values. ``identity_error`` is measured by
a pass over the fit list: largest absolute entry of the covariance of the whitened values minus the identity.

Distribution. Copies of a vector collapse in partial aggregation before the shuffle of the fit list, which is written once; every other
pass is a map with one small partial result a task.

Defined results: vectors of different lengths are different spaces, each with its own model; repeated rows and ids are
projected each; null ids pass through; components without variance (under rounding) have no whitened value and are left out, so a
space of one distinct vector has no rows; an empty vector has no component; fewer than four dimensions have so many components;
entries of 2^62 and more after scaling are an error; a deviation that does not fit 64 bits is null; other columns are ignored; an empty
table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from votepanel.session import cut_lineage

SCALE, COMPONENTS = 256.0, 4
EPS = float(np.finfo(float).eps)
#: Eigenvalues closer than this share of the norm form a cluster; those under NOISE * size * largest are no variance.
CLUSTER, NOISE, STEPS = 1e-3, 64 * EPS, 6


# ---- symmetric eigenproblem ----


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal, off-diagonal, and the unit vectors of the reflections (for rows k + 1 on)."""
    a = a.copy()
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        length = np.linalg.norm(x)
        v = x / length if length else x
        mirrors.append(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = 2 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        below = a[k + 1 :, k]
        below -= 2 * (v @ below) * v
        a[k, k + 1 :] = below
    return a.diagonal().copy(), a.diagonal(1).copy(), mirrors


def sturm_counts(diag: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point: negative pivots of the shifted matrix."""
    tiny = EPS * max(1e-300, np.abs(diag).max(initial=0) + 2 * np.abs(off).max(initial=0)) * EPS
    square = np.concatenate([[0.0], off * off])
    pivot, below = np.ones(len(points)), np.zeros(len(points), int)
    for x, s in zip(diag, square, strict=True):
        pivot = x - points - s / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until the interval has no number inside."""
    d = len(diag)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max())
    low, high = low - EPS * d * np.abs(low), high + EPS * d * np.abs(high)
    rank = d - np.arange(k)  # the j-th largest is the first point with this many below it
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return low + (high - low) / 2
        under = sturm_counts(diag, off, middle) >= rank
        high, low = np.where(under, middle, high), np.where(under, low, middle)


def _solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) z = b by elimination with row exchanges; pivots of zero are replaced by ``tiny``."""
    d = len(diag)
    main, upper, far, z = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d, b.tolist()
    lower = off.tolist()
    for i in range(d - 1):
        if abs(lower[i]) > abs(main[i]):  # exchange the rows i and i + 1
            f = main[i] / lower[i]
            main[i], upper[i], far[i], old = lower[i], main[i + 1], upper[i + 1], upper[i]
            main[i + 1], upper[i + 1] = old - f * upper[i], -f * far[i]
            z[i], z[i + 1] = z[i + 1], z[i] - f * z[i + 1]
        else:
            if abs(main[i]) < tiny:
                main[i] = tiny
            f = lower[i] / main[i]
            main[i + 1] -= f * upper[i]
            z[i + 1] -= f * z[i]
    for i in range(d - 1, -1, -1):
        if abs(main[i]) < tiny:
            main[i] = tiny
        z[i] -= upper[i] * z[i + 1] if i + 1 < d else 0.0
        z[i] -= far[i] * z[i + 2] if i + 2 < d else 0.0
        z[i] /= main[i]
    out = np.array(z)
    return out / np.abs(out).max()


def leading_vectors(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns (largest entry positive)."""
    d = len(a)
    k = min(k, d)
    largest = np.abs(a).max(initial=0)
    if not k or not largest:
        return np.zeros(k), np.eye(d, k)
    a = a / largest
    diag, off, mirrors = tridiagonal(a)
    values = leading_values(diag, off, k)
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0))
    found: list[np.ndarray] = []
    random = np.random.default_rng(13)
    for j in range(k):
        cluster = [z for z, e in zip(found, values, strict=False) if abs(e - values[j]) <= CLUSTER * norm]
        # equal shifts would give one vector again and again: part them by rounding
        shift = values[j] - sum(abs(e - values[j]) <= 4 * EPS * norm for e in values[:j]) * 4 * EPS * norm
        z = random.standard_normal(d)
        for _ in range(STEPS):
            for _ in range(2):
                for other in cluster:
                    z = z - (other @ z) * other
            z = _solve_shifted(diag, off, shift, z / np.linalg.norm(z), EPS * norm)
        for _ in range(2):
            for other in cluster:
                z = z - (other @ z) * other
        found.append(z / np.linalg.norm(z))
    vectors = np.stack(found, axis=1)
    for i, v in reversed(list(enumerate(mirrors))):
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values * largest, vectors


# ---- passes over the rows ----


@dataclass
class Space:
    """The model of the vectors of one length: centre m + rest / n, components (columns) over the roots of their eigenvalues."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    project: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y - self.rest.astype(float) / self.n) @ self.project

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """sum (n x - S)^2 of every centred row: whole numbers modulo 2^64, right where the true sum is under 2^63."""
        about = ((y - self.rest.astype(float) / self.n) ** 2).sum(axis=1) * float(self.n) ** 2
        with np.errstate(over="ignore"):
            v = y.astype(np.uint64) * np.uint64(self.n) - self.rest.astype(np.uint64)
            exact = (v * v).sum(axis=1, dtype=np.uint64).astype(np.int64).tolist()
        out: list[int | None] = exact
        for i in np.flatnonzero(about > 2.0**63 * (1 - 1e-6)).tolist():
            true = None
            if about[i] < 2.0**63 * (1 + 1e-6):
                true = sum((self.n * int(c) - int(r)) ** 2 for c, r in zip(y[i], self.rest, strict=True))
            out[i] = true if true is not None and true < 1 << 63 else None
        return out


def _fixed(c: Column) -> Column:
    v = c.cast("double") * SCALE
    return F.when(F.abs(v) < 2.0**62, F.floor(v)).otherwise(F.raise_error(F.lit("an embedding entry is too large for fixed point")).cast("long"))


def fixed_point(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x``: whole-number vectors of the rows that take part."""
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where(F.col("embedding").isNotNull()).where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", _fixed).alias("x")).where(F.size("x") > 0)


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors of each length."""
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, flat[starts[rows][:, None] + np.arange(length)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length: entry -1 is the number of vectors, the others are sums."""
    total: dict[int, list] = {}
    for batch in batches:
        for length, rows, x in _by_length(batch.column(0)):
            exact = x.sum(axis=0) if float(np.abs(x).max()) * len(x) < 2.0**62 else x.astype(object).sum(axis=0)
            old = total.setdefault(length, [0] * (length + 1))
            total[length] = [a + int(b) for a, b in zip(old, [len(rows), *exact.tolist()], strict=True)]
    cols = zip(*((d, i - 1, str(s)) for d, sums in total.items() for i, s in enumerate(sums)), strict=True) if total else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string()), strict=True)], names=["d", "i", "s"])


def products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of whole numbers, as Python integers; in doubles where every sum stays under 2^53."""
    block = 2.0**53 / max(1.0, float(np.abs(y).max(initial=0)) ** 2)
    if block < 16:
        return y.astype(object).T @ y.astype(object)
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for k in range(0, len(y), int(min(block, len(y)))):
        part = y[k : k + int(min(block, len(y)))].astype(float)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def _moments(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in _by_length(batch.column(0)):
                total[length] = products(x - centres[length]) + total.get(length, 0)
        for length, q in total.items():
            i, j = np.triu_indices(length)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), length, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([str(v) for v in q[i, j]], pa.string())], names=["d", "i", "j", "s"])

    return run


def _check(spaces: dict[int, Space]):
    """Sums and sums of products of the whitened values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, x in _by_length(batch.column(0)):
                w = spaces[length].whitened(x - spaces[length].centre)
                both = np.column_stack([np.ones(len(w)), w])
                q = both.T @ both
                i, j = np.triu_indices(len(q))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), length, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(q[i, j])], names=["d", "i", "j", "q"])

    return run


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """The model of every vector length; ``fit_list``: column ``x``, written, each vector once. Only sums over vectors reach the driver."""
    whole = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    sums: dict[int, dict[int, int]] = {}
    for r in fit_list.mapInArrow(_sums, "d int, i int, s string").groupBy("d", "i").agg(whole).collect():
        sums.setdefault(r.d, {})[r.i] = int(r.s)
    totals = {d: (s[-1], np.array([s[i] for i in range(d)], object)) for d, s in sums.items()}
    centres = {d: np.array([(2 * v + n) // (2 * n) for v in s], np.int64) for d, (n, s) in totals.items()}
    cross = {d: np.zeros((d, d), object) for d in totals}
    for r in fit_list.mapInArrow(_moments(centres), "d int, i int, j int, s string").groupBy("d", "i", "j").agg(whole).collect():
        cross[r.d][r.i, r.j] = cross[r.d][r.j, r.i] = int(r.s)
    spaces = {}
    for d, (n, s) in totals.items():
        rest = s - n * centres[d].astype(object)
        covariance = ((n * cross[d] - np.outer(rest, rest)) / (n * n)).astype(float)  # whole numbers up to the division
        values, vectors = leading_vectors(covariance, components)
        good = values > NOISE * d * values.max(initial=0)
        spaces[d] = Space(n, centres[d], rest.astype(np.int64), vectors[:, good] / np.sqrt(values[good]), values[good] / max(np.trace(covariance), 1e-300))
    found: dict[int, dict] = {}
    for r in fit_list.mapInArrow(_check(spaces), "d int, i int, j int, q double").groupBy("d", "i", "j").agg(F.sum("q").alias("q")).collect():
        found.setdefault(r.d, {})[r.i, r.j] = r.q
    for d, q in found.items():
        n, k = spaces[d].n, len(spaces[d].explained)
        spaces[d].identity_error = max((abs(q[i, j] / n - q[0, i] * q[0, j] / n**2 - (i == j)) for i in range(1, k + 1) for j in range(i, k + 1)), default=0.0)
    return spaces


def _project(spaces: dict[int, Space]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, x in _by_length(batch.column(1)):
                space = spaces[length]
                k = len(space.explained)
                y = x - space.centre
                ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
                deviation = pa.array(space.deviation(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
                m = len(rows) * k
                cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, space.n)), deviation, pa.array(space.whitened(y).ravel()), pa.array(np.tile(space.explained, len(rows))), pa.array(np.full(m, space.identity_error))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    rows = fixed_point(embeddings)
    spaces = fit(cut_lineage(rows.select("x").distinct(), "fit_list"), components)
    return rows.mapInArrow(_project(spaces), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of the whole ``embeddings`` table."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

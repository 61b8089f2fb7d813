"""Whitening of embeddings from the factor of their scatter.

Entries become whole numbers ``x = floor(256 c)``. Over the distinct vectors ``x`` (the fit list) a
first pass adds up exact sums, a second the scatter of the centred vectors. The scatter is factored
by Cholesky with diagonal pivots, and one-sided Jacobi rotations make the columns of that triangular
factor orthogonal: their squared norms are the eigenvalues of the scatter, the normalised columns its
eigenvectors. Tasks send sums only, d x d numbers for vectors of d entries, so the factoring on the
driver depends on d and not on the rows.

Defined results: rows whose vector is null or holds a null, non-finite entry or one whose whole number
leaves 64 bits are dropped; every other row stays, repeated ids and null ids included. Shorter vectors,
empty ones too, count as filled up with zeros to the longest. Directions without variance (all vectors
equal, fewer distinct vectors than dimensions) have explained 0 and whitened null. ``deviation`` is null
where it leaves 64 bits. Equal eigenvalues may come in any order. No vectors, no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antipode.llm.common import map_rows, materialize

SCALE = 256.0
COMPONENTS = 4
LONG_MAX = 2**63 - 1
#: Pivots below this share of the largest are rounding of a singular scatter.
PIVOT_SHARE = 1e-14


# ------------------------------------------------------------- whole numbers

def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values one after the other, their starts, which rows stay) of a list column."""
    flat, starts = vectors.flatten(), np.zeros(len(vectors) + 1, np.int64)
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    np.cumsum(sizes, out=starts[1:])
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE
    fits = np.isfinite(c) & (c >= -(2.0**63)) & (c < 2.0**63)
    bad = np.concatenate([[0], np.cumsum(~fits)])
    keep = (bad[starts[1:]] == bad[starts[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    return np.floor(np.where(fits, c, 0.0)).astype(np.int64), starts, keep


def _matrix(values: np.ndarray, starts: np.ndarray, keep: np.ndarray, d: int) -> np.ndarray:
    """The kept rows as a matrix of ``d`` columns, filled up with zeros."""
    sizes = np.diff(starts)
    if d and len(values) == len(keep) * d and (sizes == d).all():
        return values.reshape(-1, d)[keep]
    out = np.zeros((int(keep.sum()), d), np.int64)
    for row, i in enumerate(np.flatnonzero(keep)):
        out[row, : sizes[i]] = values[starts[i]:starts[i + 1]]
    return out


def _packed(x: np.ndarray) -> bytes:
    """One spelling per vector: zeros at the end cut off, little-endian in the least width of 1, 2, 4 or 8 bytes."""
    used = np.flatnonzero(x)
    x = x[: used[-1] + 1] if len(used) else x[:0]
    width = next(w for w in (1, 2, 4, 8) if not len(x) or (-(1 << 8 * w - 1) <= int(x.min()) and int(x.max()) < 1 << 8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _unpacked(codes: list[bytes], d: int) -> np.ndarray:
    out = np.zeros((len(codes), d), np.int64)
    for row, code in enumerate(codes):
        x = np.frombuffer(code, f"<i{code[0]}", offset=1)
        out[row, : len(x)] = x
    return out


def fit_list(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(code, size): each distinct whole-number vector once, with the longest length it came in."""
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            values, starts, keep = whole_numbers(cols["vec"])
            rows = np.flatnonzero(keep)
            yield {"code": [_packed(values[starts[i]:starts[i + 1]]) for i in rows], "size": np.diff(starts)[rows]}

    coded = map_rows(vectors.select(F.col(vec_col).alias("vec")), "code binary, size long", work)
    return coded.groupBy("code").agg(F.max("size").alias("size"))  # copies collapse in the map tasks


# ----------------------------------------------------------------- factoring

def pivoted_cholesky(scatter: np.ndarray, least: float = PIVOT_SHARE) -> np.ndarray:
    """``factor`` with ``factor @ factor.T = scatter``: lower triangular once its rows are put in pivot order.

    One column per pivot, largest remaining diagonal first; it ends where the rest is rounding.
    """
    d = len(scatter)
    rest = scatter.diagonal().astype(float).copy()
    factor = np.zeros((d, d))
    first = rest.max(initial=0.0)
    free = np.ones(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(free, rest, -np.inf)))
        if first <= 0 or rest[p] <= least * first:
            return factor[:, :k]
        free[p] = False
        root = np.sqrt(rest[p])
        column = (scatter[:, p] - factor[:, :k] @ factor[p, :k]) / root
        factor[:, k] = np.where(free, column, 0.0)
        factor[p, k] = root
        rest -= factor[:, k] ** 2
    return factor


def _rounds(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of 0..r-1 in rounds of disjoint pairs, every pair once."""
    seats = np.arange(r + r % 2)
    for _ in range(len(seats) - 1):
        a, b = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
        real = (a < r) & (b < r)
        yield np.minimum(a, b)[real], np.maximum(a, b)[real]
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])


def one_sided_jacobi(factor: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated until they are orthogonal, longest first."""
    u = factor.copy()
    for _ in range(sweeps):
        worst = 0.0
        for p, q in _rounds(u.shape[1]):
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa) * np.sqrt(bb)
            turn = np.abs(ab) > tolerance * size
            if not turn.any():
                continue
            worst = max(worst, float((np.abs(ab[turn]) / size[turn]).max()))
            zeta = (bb - aa) / np.where(turn, 2.0 * ab, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1.0 / np.hypot(1.0, t)
            u[:, p], u[:, q] = c * (a - t * b), c * (t * a + b)
        if worst <= 4 * tolerance:
            break
    return u[:, np.argsort(-(u * u).sum(0), kind="stable")]


# --------------------------------------------------------------------- model

@dataclass
class Whitening:
    """``total`` are exact sums of the ``n`` fitted vectors; ``components`` are rows, longest variance first."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(x - S / n, n x - S where whole numbers of 64 bits hold its squares else None)."""
        top = int(np.abs(x.astype(float)).max(initial=0)) + 1
        bound = self.n * top + max((abs(t) for t in self.total), default=0)
        if bound * bound * max(1, len(self.total)) <= LONG_MAX:
            exact = self.n * x - np.array(self.total, np.int64)
            return exact / self.n, exact
        whole, part = zip(*(divmod(t, self.n) for t in self.total), strict=True)
        return (x.astype(object) - np.array(whole, object)).astype(float) - np.array([p / self.n for p in part]), None

    def deviation(self, x: np.ndarray, exact: np.ndarray | None) -> list[int | None]:
        if exact is not None:
            return (exact * exact).sum(1).tolist()
        sums = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.total, strict=True)) for row in x.tolist()]
        return [s if s <= LONG_MAX else None for s in sums]

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred @ self.components.T) / np.sqrt(np.where(self.values > 0, self.values, np.nan))


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of lists per ``i``, one list per task and ``i``; what reaches the driver depends on the lists alone."""
    out = rows.select("i", F.posexplode("v").alias("k", "v")).groupBy("i", "k").agg(F.sum("v").alias("v"))
    found: dict[int, list] = {}
    for r in out.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s")).collect():
        found[r.i] = np.array([s.v for s in r.s])
    return found


def _column_sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sums: high and low halves of the numbers apart, so that 64 bits hold two thousand million of each."""
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for cols in batches:
            x = _unpacked(cols["code"].to_pylist(), d)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield {"i": [0, 1], "v": [high.tolist(), low.tolist()]}

    sums = _summed(map_rows(fit.select("code"), "i int, v array<long>", work))
    return [(int(h) << 32) + int(lo) for h, lo in zip(sums[0], sums[1], strict=True)]


def _scatter(fit: DataFrame, d: int, centre) -> np.ndarray:
    """Sum of outer products of ``centre(vectors)``, a list per row of the matrix and task."""
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        total = None
        for cols in batches:
            y = centre(_unpacked(cols["code"].to_pylist(), d))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield {"i": np.arange(len(total), dtype=np.int32), "v": total.tolist()}

    sums = _summed(map_rows(fit.select("code"), "i int, v array<double>", work))
    return np.array([sums[i] for i in range(len(sums))]).reshape(len(sums), -1)


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """(model, fit list); no model if no row stays."""
    fitted = materialize(fit_list(vectors, vec_col), "fit_list")
    n, d = fitted.agg(F.count(F.lit(1)), F.max("size")).first()
    if not n:
        return None, fitted
    total = _column_sums(fitted, d) if d else []
    model = Whitening(n, total, np.zeros((0, d)), np.zeros(0), 0.0)
    if d:
        scatter = _scatter(fitted, d, lambda x: model.centred(x)[0])
        columns = one_sided_jacobi(pivoted_cholesky(scatter))
        norms = np.sqrt((columns * columns).sum(0))
        k = min(components, d)
        found = min(k, len(norms))
        model.components, model.values = np.zeros((k, d)), np.zeros(k)
        model.components[:found] = (columns[:, :found] / norms[:found]).T
        model.values[:found] = norms[:found] ** 2 / n
        model.trace = float(np.trace(scatter)) / n
    return model, fitted


def identity_error(model: Whitening, fitted: DataFrame) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity, over components with variance."""
    d, used = len(model.total), model.values > 0
    if not used.any():
        return None
    white = lambda x: model.project(model.centred(x)[0])[:, used]

    def sums(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(int(used.sum()))
        for cols in batches:
            total += white(_unpacked(cols["code"].to_pylist(), d)).sum(0)
        yield {"i": [0], "v": [total.tolist()]}

    mean = _summed(map_rows(fitted.select("code"), "i int, v array<double>", sums))[0] / model.n
    covariance = _scatter(fitted, d, lambda x: white(x) - mean) / model.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per staying row and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, fitted = fit(vectors, vec_col, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k, d = identity_error(model, fitted), len(model.values), len(model.total)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            values, starts, keep = whole_numbers(cols["vec"])
            x = _matrix(values, starts, keep, d)
            rows = len(x)
            centred, exact = model.centred(x)
            yield {id_col: cols["id"].take(pa.array(np.repeat(np.flatnonzero(keep), k))),
                   "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows), "n": np.full(rows * k, model.n),
                   "deviation": [v for v in model.deviation(x, exact) for _ in range(k)],
                   "whitened": pa.array(model.project(centred).ravel(), from_pandas=True),
                   "explained": np.tile(explained, rows), "identity_error": pa.array([error] * (rows * k), pa.float64())}

    return map_rows(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), schema, work)

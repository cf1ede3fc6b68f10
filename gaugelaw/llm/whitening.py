"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers; each distinct one counts once in the fit. Sums are exact. The
covariance V is never formed: a pass over the distributed vectors gives V Q for a block Q of a few columns,
centred before it multiplies. A few Lanczos steps bound the spectrum from below; then each round filters the
block by a Chebyshev polynomial of V, which damps what lies between that bound and the block's least
Ritz value, and ends with QR and Rayleigh-Ritz. Components whose residual is at rounding level are
locked. Random probes outside the block go through the same polynomial: unless they come out
small, some eigenvalue as large as a wanted one may lie there (Halko, Martinsson and Tropp 2011, lemma 4.1: ten
probes err with a chance of 1e-10), and the search goes on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

PROBES = 10
Apply = Callable[[np.ndarray], np.ndarray]


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """Rows (id, x array<long>), x = floor(scale * c); without null vectors and those with a null, a non-finite or a far too large entry."""
    most = 2.0**62 / scale
    good: Callable[[Column], Column] = lambda c: F.coalesce(F.abs(c.cast("double")) < most, F.lit(False))
    v = F.col(f"`{vector_col}`")
    kept = rows.filter(v.isNotNull() & F.forall(v, good))
    return kept.select(F.col(f"`{id_col}`").alias("id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def common_length(vectors: DataFrame) -> int | None:
    """The commonest number of entries, the smaller one of ties; None without any."""
    size = F.size("x")
    row = vectors.groupBy(size.alias("d")).count().filter("d > 0").orderBy(F.desc("count"), "d").first()
    return row and row["d"]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit_blocks(vectors: DataFrame, dims: int, each: int = 4096) -> DataFrame:
    """The distinct vectors, written: rows (block binary) of up to `each` vectors of little-endian long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, each):
                yield pa.RecordBatch.from_arrays([pa.array([_matrix(b.column(0).slice(at, each), dims).astype("<i8").tobytes()], pa.binary())], names=["block"])

    return materialise(vectors.select("x").distinct().mapInArrow(run, "block binary"), "whitening")


class Fit:
    """Sums over the blocks: each task adds up its own, a shuffle the tasks' sums; the driver gets a few numbers for each dimension."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims = blocks, dims
        split = self._sums(lambda x: np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]), 2 * dims + 1, pa.int64())
        self.n = int(split[0])
        self.totals = [(int(h) << 32) + int(low) for h, low in zip(split[1 : dims + 1], split[dims + 1 :])]
        self.mean = np.array([s / self.n for s in self.totals]) if self.n else np.zeros(dims)
        mean = self.mean
        self.trace = float(self._sums(lambda x: np.array([np.square(x - mean).sum()]), 1, pa.float64())[0]) / self.n if self.n else 0.0

    def _sums(self, work: Callable[[np.ndarray], np.ndarray], size: int, kind: pa.DataType) -> list:
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for block in b.column(0).to_pylist():
                    found = work(np.frombuffer(block, "<i8").reshape(-1, dims))
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total, kind)], names=["i", "v"])

        whole = kind == pa.int64()
        parts = self.blocks.mapInArrow(run, f"i long, v {'long' if whole else 'double'}")
        rows = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(28,0)") if whole else "v").alias("v")).collect()
        out = [0] * size
        for r in rows:
            out[r["i"]] = r["v"]
        return out

    def apply(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        mean, n, shape = self.mean, self.n, q.shape

        def work(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return (c.T @ (c @ q)).ravel()

        return np.array(self._sums(work, q.size, pa.float64())).reshape(shape) / n

    def whitened_moments(self, q: np.ndarray) -> np.ndarray:
        """Covariance of what q makes of the centred vectors."""
        mean, n, k = self.mean, self.n, q.shape[1]

        def work(x: np.ndarray) -> np.ndarray:
            z = (x - mean) @ q
            return np.concatenate([z.sum(0), (z.T @ z).ravel()])

        found = np.array(self._sums(work, k + k * k, pa.float64())) / n
        return found[k:].reshape(k, k) - np.outer(found[:k], found[:k])


def least_eigenvalue(apply: Apply, dims: int, rng: np.random.Generator, steps: int = 10) -> float:
    """A lower bound, but for bad luck, of the spectrum: the least Ritz value of a few Lanczos steps less its residual."""
    q = rng.standard_normal(dims)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dims)):
        w = apply(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):
            for b in basis:
                w = w - (w @ b) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(abs(a) for a in alpha):
            break
        basis.append(w / beta[-1])
    m = len(alpha)
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1))
    return max(0.0, float(values[0] - abs(beta[-1] * vectors[-1, 0]) - 1e-3 * (values[-1] - values[0])))


def degree_of(low: float, high: float, wanted: float, top: float, gain: float = 1e5, spread: float = 1e7, most: int = 24) -> int:
    """The least degree that lifts `wanted` by `gain` over what is damped, unless `top` would then drown it."""
    centre, half = (low + high) / 2, (high - low) / 2
    of = lambda v: math.acosh(max(1 + 1e-9, (v - centre) / half))
    need = math.ceil(math.log(2 * gain) / of(wanted))
    allowed = math.floor(math.log(spread) / max(1e-9, of(top) - of(wanted)))
    return max(2, min(need, allowed, most))


def chebyshev(apply: Apply, x: np.ndarray, low: float, high: float, at: float, degree: int, outside: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """p(V) x by the three-term recurrence, where p is the Chebyshev polynomial of [low, high] with p(at) = 1."""
    centre, half = (low + high) / 2, (high - low) / 2
    first = half / (at - centre)
    sigma, before, now = first, x, outside(apply(x) - centre * x) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, outside(apply(now) - centre * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def top_components(apply: Apply, dims: int, trace: float, wanted: int = 4, guard: int = 20, tolerance: float = 1e-12, rounds: int = 60, seed: int = 11) -> tuple[np.ndarray, np.ndarray, bool]:
    """(eigenvalues, columns, certified) of the `wanted` largest eigenvalues of V, falling; apply(Q) is V Q.

    certified: every residual is at most tolerance times the largest eigenvalue, and probes have shown
    that no eigenvalue as large as a wanted one lies outside the block. Equal eigenvalues (ties) give any basis of their
    space; where more equal the last wanted one than the block has room for, probes cannot tell them apart: then
    certified is false.
    """
    wanted = min(wanted, dims)
    if trace <= 0:
        return np.zeros(wanted), np.eye(dims)[:, :wanted], True
    rng = np.random.default_rng(seed)
    size = min(dims, wanted + guard)
    low = least_eigenvalue(apply, dims, rng) if size < dims else 0.0
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    x = np.linalg.qr(rng.standard_normal((dims, size)))[0]
    certified, last, stalled = size == dims, np.inf, 0
    for turn in range(rounds):
        # Rayleigh-Ritz on the block, which is orthogonal to what is locked
        w = apply(x)
        theta, u = np.linalg.eigh((x.T @ w + w.T @ x) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        x, w = x @ u, w @ u
        residual = np.linalg.norm(w - x * theta, axis=0)
        top = max([*values, theta[0]])
        open_ = wanted - len(values)
        stalled = stalled + 1 if open_ and turn and residual[:open_].max() > 0.5 * last else 0
        last = residual[:open_].max() if open_ else last
        # at the level of rounding a residual falls no further
        ready = (residual[:open_] <= tolerance * top) | (residual[:open_] <= 1e-10 * top) & (stalled >= 3)
        n = int(ready.argmin()) if not ready.all() else open_
        if n:
            locked, values = np.hstack([locked, x[:, :n]]), np.append(values, theta[:n])
            x, theta = x[:, n:], theta[n:]
        open_ -= n
        if not open_ and (certified or size == dims or turn == rounds - 1):
            break
        if not x.shape[1]:
            break
        at = theta[open_ - 1] if open_ else values[-1]
        # what lies below is zero but for rounding
        high = max(float(theta[-1]), 1e-6 * float(theta[0]), 1e-13 * top)
        if at < high * (1 + 1e-12) and not open_ and theta[-1] >= high:
            break  # the damped part reaches the wanted one: a tie
        at, low = max(at, high * (2 if theta[-1] < high else 1.001)), low if low < 0.999 * high else 0.0
        degree = degree_of(low, high, at, float(theta[0]) if open_ else at)
        inside = np.hstack([locked, x])
        g = rng.standard_normal((dims, PROBES))
        g -= inside @ (inside.T @ g)
        k = x.shape[1]

        def outside(y: np.ndarray, held: np.ndarray = locked, whole: np.ndarray = inside, k: int = k) -> np.ndarray:
            return np.hstack([y[:, :k] - held @ (held.T @ y[:, :k]), y[:, k:] - whole @ (whole.T @ y[:, k:])])

        y = chebyshev(apply, np.hstack([x, g]), low, high, at, degree, outside)
        certified = bool(10 * math.sqrt(2 / math.pi) * np.linalg.norm(y[:, k:], axis=0).max() < 1)
        if not certified and turn:
            # what the probes found outside takes the places of the last guards; the lower bound may have been too high
            take = min(PROBES, max(0, k - open_) // 2)
            y[:, k - take : k], low = y[:, k : k + take], 0.0 if turn > 2 else low
        y = y[:, :k] / np.linalg.norm(y[:, :k], axis=0)
        for _ in range(2):
            y = np.linalg.qr(y - locked @ (locked.T @ y))[0]
        x = y
    if len(values) < wanted:
        locked, values, certified = np.hstack([locked, x[:, : wanted - len(values)]]), np.append(values, theta[: wanted - len(values)]), False
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order], certified


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """Rows (id_col, component, n, deviation decimal, whitened, explained, identity_error, certified): each vector in each component.

    Rows without a vector or with a null, a non-finite or a far too large entry (over 2**62 / scale) are left out, and so
    are those whose length is not the commonest one (of ties the smaller). Repeated vectors count once in the fit and each
    get their rows; repeated and null ids are kept. Equal eigenvalues (ties) give any basis of their space. A vector of any
    length fits as long as a block of 4 + 20 columns does. With fewer dimensions than components there are fewer; an
    eigenvalue of zero (one vector alone) has a null whitened. deviation is null if it has more than 38 digits.
    Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    vectors = whole_numbers(rows, id_col, vector_col, scale)
    dims = common_length(vectors)
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, certified boolean"
    if dims is None:
        return spark.createDataFrame([], schema)
    vectors = vectors.filter(F.size("x") == dims)
    fit = Fit(fit_blocks(vectors, dims), dims)
    values, basis, certified = top_components(fit.apply, dims, fit.trace, components)
    live = values > 1e-13 * max(fit.trace, 0)
    maps = np.where(live, basis / np.sqrt(np.where(live, values, 1)), np.nan)
    error = float(np.abs(fit.whitened_moments(maps[:, live]) - np.eye(live.sum())).max()) if live.any() else None
    n, mean, totals = fit.n, fit.mean, fit.totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(totals, object)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = _matrix(part.column(1), dims)
                far = max(float(np.abs(x).max()) * n + max(abs(t) for t in totals), 1.0)
                if far * far * dims < 2.0**62:
                    apart = x * n - sums.astype(np.int64)
                    deviation = pa.array((apart * apart).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    exact = ((x.astype(object) * n - sums) ** 2).sum(1)
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                z = (x - mean) @ maps
                white = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, white], names=["id", "deviation", "white"])

    found = vectors.mapInArrow(run, f"id {kind}, deviation decimal(38,0), white array<double>")
    share = F.array(*(F.lit(float(v / fit.trace) if fit.trace > 0 else None).cast("double") for v in values))
    each = found.select("id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), F.lit(certified).alias("certified"),
    )

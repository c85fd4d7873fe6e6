"""Embedding whitening: leading principal components by slicing the spectrum of the covariance.

1. Entries become integers, floor(SCALE * c).  Each different vector counts once: the fit list.
2. Spark sums the fit list per dimension, exactly, then the products of the centred vectors.  Only these
   sums, d and d * d numbers for d dimensions however many rows there are, reach the driver.
3. The LDL' factors of V - s I have as many positive pivots as V has eigenvalues above s (inertia).  Bisection
   on these counts isolates each leading eigenvalue; Rayleigh quotient iteration, started inside the
   interval, converges cubically; counts on both sides of the result certify its number.  Eigenvalues that
   no interval can tell apart in double precision share an invariant subspace, any basis of which will do.
4. Each row is projected on the components, and so is the fit list once more, to measure how far the
   covariance of the result is from the identity.

Cases: rows whose vector is null or holds a null, a NaN or an infinity go; so do rows of another length than
most vectors have (of equally frequent ones the longest counts).  Entries beyond the range of a long are its
ends; a deviation beyond it is null.  Components whose eigenvalue is no more than the rounding of the trace
(fewer different vectors than components, or constant entries) cannot be whitened and are left out, so
one vector alone, vectors without entries, and an empty table give no rows.  Repeated rows and null ids are
whitened like others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.base import prepare, settle

SCALE, COMPONENTS = 256, 4
#: Largest number of dimensions: the covariance is one matrix on the driver.
DIMENSIONS = 8192
_EPS = float(np.finfo(float).eps)


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above the shift: positive pivots of P (A - s I) P' = L D L'.

    Pivots of one or two rows, chosen as Bunch and Kaufman do; a pivot of two has one positive eigenvalue.
    """
    a = matrix - shift * np.eye(len(matrix))
    alpha, count = (1 + 17**0.5) / 8, 0
    tiny = _EPS * max(np.abs(matrix).max(initial=0.0), abs(shift), np.finfo(float).tiny)
    while (n := len(a)) > 0:
        below = np.abs(a[1:, 0])
        r = int(below.argmax()) + 1 if n > 1 else 0
        most = below[r - 1] if n > 1 else 0.0
        size, swap = 1, 0
        if abs(a[0, 0]) < alpha * most:
            row = np.abs(a[r])
            row[r] = 0.0
            other = row.max()
            if abs(a[0, 0]) * other >= alpha * most * most:
                pass
            elif abs(a[r, r]) >= alpha * other:
                swap = r
            else:
                size, swap = 2, r
        if swap and size == 1:
            a[[0, swap]] = a[[swap, 0]]
            a[:, [0, swap]] = a[:, [swap, 0]]
        elif swap > 1:
            a[[1, swap]] = a[[swap, 1]]
            a[:, [1, swap]] = a[:, [swap, 1]]
        if size == 1:
            pivot = a[0, 0]
            if abs(pivot) <= tiny and most <= tiny:
                pivot = -tiny  # an eigenvalue at the shift is not above it
            count += pivot > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0] / pivot)
        else:
            count += 1
            c = a[2:, :2]
            a = a[2:, 2:] - c @ np.linalg.solve(a[:2, :2], c.T)
    return int(count)


def _solve(matrix: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    """(A - s I) y = x; at an eigenvalue itself with a shift next to it."""
    size = np.abs(matrix).max()
    for k in range(4):
        try:
            y = np.linalg.solve(matrix - (shift + k * _EPS * size) * np.eye(len(matrix)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    raise ArithmeticError("the shifted covariance stays singular")


def _narrowed(matrix: np.ndarray, k: int, low: float, high: float, width: float) -> tuple[float, float]:
    """Bisects an interval that holds the k-th largest eigenvalue down to a width."""
    while high - low > width:
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (mid, high) if above(matrix, mid) >= k else (low, mid)
    return low, high


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenvalues, falling, and their unit vectors as rows."""

    values: np.ndarray
    vectors: np.ndarray


def leading(matrix: np.ndarray, count: int = COMPONENTS) -> Spectrum:
    """The leading eigenvalues of a covariance that are above rounding, each one numbered by inertia counts."""
    d, trace = len(matrix), float(np.trace(matrix)) if len(matrix) else 0.0
    if d == 0 or not trace > 0:
        return Spectrum(np.zeros(0), np.zeros((0, d)))
    # In units of the trace, all eigenvalues lie in [0, 1].
    v = (matrix + matrix.T) / (2 * trace)
    noise = d * _EPS
    count = min(count, above(v, noise))
    rng = np.random.default_rng(0)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    while len(values) < count:
        k = len(values) + 1
        low, high = 0.0, (values[-1] + noise if values else 1.0) + noise
        # As narrow as the eigenvalue is alone in it, or as doubles can tell.
        while True:
            low, high = _narrowed(v, k, low, high, max((high - low) / 4, noise))
            many = above(v, low) - above(v, high)
            if many == 1 or high - low <= noise:
                break
        if many == 1:
            value, x = _iterated(v, k, low, high, noise, vectors, rng)
            values.append(value)
            vectors.append(x)
            continue
        # Eigenvalues that doubles cannot tell apart: inverse iteration on a block, whose basis is any.
        block = rng.standard_normal((d, many))
        for _ in range(6):
            block = _orthogonal(_solve(v, (low + high) / 2, block), vectors)
        for x in block.T[: count - len(values)]:
            values.append(float(x @ v @ x))
            vectors.append(x)
    return Spectrum(trace * np.asarray(values), np.asarray(vectors))


def _orthogonal(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Columns made orthonormal, and orthogonal to other vectors."""
    for _ in range(2):
        for o in others:
            x = x - np.outer(o, o @ x)
        x = np.linalg.qr(x)[0]
    return x


def _iterated(v: np.ndarray, k: int, low: float, high: float, noise: float, others: list[np.ndarray], rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """The k-th eigenvalue, alone between low and high, and its vector; certified by counts on both sides."""
    while True:
        x = _orthogonal(rng.standard_normal((len(v), 1)), others)
        shift = (low + high) / 2
        for _ in range(2):
            x = _orthogonal(_solve(v, shift, x), others)
        for _ in range(12):
            shift = float((x.T @ v @ x)[0, 0])
            rest = float(np.linalg.norm(v @ x - shift * x))
            if rest <= noise or not low <= shift <= high:
                break
            x = _orthogonal(_solve(v, shift, x), others)
        radius = max(rest, noise)
        if low <= shift <= high and rest <= 8 * noise and above(v, shift - radius) >= k > above(v, shift + radius):
            return shift, x[:, 0]
        if high - low <= noise:
            return shift, x[:, 0]
        # The iteration went to a neighbour: start closer.
        low, high = _narrowed(v, k, low, high, max((high - low) / 8, noise))


def _per_matrix(df: DataFrame, schema: str, d: int, work: Callable[[pa.RecordBatch, np.ndarray], dict]) -> DataFrame:
    """mapInArrow with the vectors ``x`` of a batch as one matrix of longs."""
    prepare(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out_schema)

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            if batch.num_rows:
                x = batch.column(batch.schema.names.index("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                out = work(batch, x)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out_schema)


def _fits(x: np.ndarray, times: int) -> bool:
    """Whether so many of these numbers can be summed as longs."""
    return times * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 2**62


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x: rows with finite vectors of the commonest length, in whole parts of 1 / scale."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    good = own.where(F.col("v").isNotNull() & finite)
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    d = lengths.agg(F.max(F.struct("n", "d"))["d"]).first()[0] or 0
    if d > DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the covariance is bounded to {DIMENSIONS}")
    return good.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(scale * c)).alias("x"))


def _totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and their exact sums per dimension."""

    def work(batch: pa.RecordBatch, x: np.ndarray) -> dict:
        sums = x.sum(axis=0).tolist() if _fits(x, len(x)) else x.astype(object).sum(axis=0).tolist()
        return {"n": [len(x), *[0] * (d - 1)], "pos": list(range(d)), "s": [Decimal(v) for v in sums]}

    rows = _per_matrix(fit, "n long, pos int, s decimal(38,0)", d, work).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums = {r["pos"]: int(r["s"]) for r in rows}
    return sum(r["n"] for r in rows), [sums.get(i, 0) for i in range(d)]


def _covariance(fit: DataFrame, d: int, n: int, mean: np.ndarray) -> np.ndarray:
    """The covariance of the fit list, centred before multiplying; tasks add up before anything is shuffled."""
    prepare(fit.sparkSession)

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in them:
            if batch.num_rows:
                y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d) - mean
                total += y.T @ y
        if total.any():
            a, b = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])], names=["a", "b", "v"])

    out = np.zeros((d, d))
    for r in fit.select("x").mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect():
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["v"] / n
    return out


def _identity_error(fit: DataFrame, d: int, n: int, mean: np.ndarray, map_: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    prepare(fit.sparkSession)
    k = len(map_)

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in them:
            if batch.num_rows:
                w = (batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d) - mean) @ map_.T
                w = np.column_stack([np.ones(len(w)), w])
                total += w.T @ w
        a, b = np.indices((k + 1, k + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])], names=["a", "b", "v"])

    sums = np.zeros((k + 1, k + 1))
    for r in fit.select("x").mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v")).collect():
        sums[r["a"], r["b"]] = r["v"] / n
    # Whitened values are centred already: their mean is no more than rounding.
    cov = sums[1:, 1:] - np.outer(sums[0, 1:], sums[0, 1:])
    return float(np.abs(cov - np.eye(k)).max(initial=0.0))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2 of each row, exact; null beyond a long."""
    most = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))]) * n + max(map(abs, sums))
    if len(sums) * most * most < 2**62:
        y = n * x - np.asarray(sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    s = np.asarray(sums, dtype=object)
    exact = ((n * x.astype(object) - s) ** 2).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue: a row per vector and component."""
    rows = scaled(vectors, scale)
    fit = settle(rows.select("x").distinct())
    first = fit.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums = _totals(fit, d)
    mean = np.asarray([s / n for s in sums])
    cov = _covariance(fit, d, n, mean)
    top = leading(cov, components)
    k, trace = len(top.values), float(np.trace(cov))
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    map_ = top.vectors / np.sqrt(top.values)[:, None]
    error = _identity_error(fit, d, n, mean, map_)
    values, explained = top.values.tolist(), (top.values / trace).tolist()

    def work(batch: pa.RecordBatch, x: np.ndarray) -> dict:
        m = len(x)
        ids = batch.column(batch.schema.names.index("vec_id")).to_pylist()
        return {
            "vec_id": [i for i in ids for _ in range(k)],
            "component": list(range(1, k + 1)) * m,
            "n": [n] * (m * k),
            "deviation": [v for v in deviations(x, n, sums) for _ in range(k)],
            "whitened": ((x - mean) @ map_.T).reshape(-1),
            "explained": explained * m,
            "identity_error": [error] * (m * k),
            "eigenvalue": values * m,
        }

    return _per_matrix(rows, schema, d, work)

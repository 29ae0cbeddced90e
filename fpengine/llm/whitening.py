"""Operator 11: embedding whitening with a polarisation covariance.

Each entry c becomes the integer x = floor(64 c) + 1 000 000 (64 c saturates at 2^62; the constant cancels in all results, so it is not added). The fit list holds each distinct
integer vector once. A first pass sums it exactly; a second one, over values shifted by the integer next below the mean, aggregates
the exact sum of squares of every dimension and of the sum of every pair of dimensions. With n rows, the square sums of n x - S follow
exactly, and half the difference "pair less its two dimensions" is n^3 times the covariance: no product of two
dimensions is ever formed. The matrix goes to ``eigh``; its eigenvectors are then refined in extended precision, so that
they are right to the last bits of a double also where eigenvalues lie close. A third pass measures the covariance of the whitened fit list.

What reaches the driver is one number per pair of dimensions, whatever the number of rows. Partial sums are split into
32-bit limbs, so that Spark's long sums stay exact at any size.

Defined results: rows with a null or empty vector or null or non-finite entries are dropped; vectors of different lengths are
whitened apart, each length by its own fit; repeated rows and ids each get their rows, and count once in the fit; a null id stays
null; a component without variance has whitened null and explained 0; deviation is null beyond a long; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpengine.llm.common import discard, spark_of, stage
from fpengine.llm.vectors import integer_vectors, matrices

SCALE = 64
COMPONENTS = 16
LIMBS = 6  # five of 32 bits and a signed rest: 2^40 rows of squares of 65-bit numbers fit
_SUMS = "dims int, k long, n long, " + ", ".join(f"l{i} long" for i in range(LIMBS))
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _limbs(value: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return out + [value]


def _sum_batch(sums: dict, counts: dict):
    """The partial sums of one task as one Arrow batch per length: k is the number of the sum."""
    import pyarrow as pa
    for d, (index, total) in sums.items():
        cols = np.array([_limbs(int(t)) for t in total], dtype=np.int64).reshape(-1, LIMBS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(index), d, dtype=np.int32)), pa.array(index), pa.array(np.full(len(index), counts[d], dtype=np.int64))]
            + [pa.array(np.ascontiguousarray(cols[:, i])) for i in range(LIMBS)], names=["dims", "k", "n"] + [f"l{i}" for i in range(LIMBS)])


def _total(partial: DataFrame) -> dict[int, tuple[int, dict[int, int]]]:
    """{dims: (rows, {k: exact sum})}; as many numbers as the lengths have sums."""
    t = partial.groupBy("dims", "k").agg(F.sum("n").alias("n"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)]).toArrow()
    out: dict[int, tuple[int, dict[int, int]]] = {}
    cols = [t.column(f"l{i}").to_pylist() for i in range(LIMBS)]
    for d, k, n, *parts in zip(t.column("dims").to_pylist(), t.column("k").to_pylist(), t.column("n").to_pylist(), *cols):
        out.setdefault(d, (n, {}))[1][k] = sum(p << (32 * i) for i, p in enumerate(parts))
    return out


def _exact(v: np.ndarray, bits: int) -> np.ndarray:
    """``v`` as it is if results of ``bits`` bits over its values stay below 2^62, else as Python integers."""
    return v if bits < 62 else v.astype(object)


def _bits(v: np.ndarray) -> int:
    return max(int(v.max(initial=0)), -int(v.min(initial=0)), 1).bit_length()


def _dimension_sums(batches):
    sums, counts = {}, {}
    for batch in batches:
        for _, d, v in matrices(batch):
            part = _exact(v, _bits(v) + len(v).bit_length()).sum(axis=0).astype(object)
            index, old = sums.get(d, (np.arange(d, dtype=np.int64), 0))
            sums[d], counts[d] = (index, old + part), counts.get(d, 0) + len(v)
    yield from _sum_batch(sums, counts)


def _square_sums(shift):
    """Sums of squares of every dimension (k = i d + i) and of every pair's sum (k = i d + j, i < j)."""
    def run(batches):
        sums, counts = {}, {}
        for batch in batches:
            for _, d, v in matrices(batch, most=1 << 18):
                y = _shifted(v, shift.value[d])
                y = _exact(y, 2 * (_bits(y) + 1) + len(y).bit_length()) if y.dtype != object else y
                if d not in sums:
                    i, j = np.triu_indices(d)
                    sums[d] = (i * np.int64(d) + j, np.zeros(len(i), dtype=object))
                at, total = 0, sums[d][1]
                for i in range(d):
                    pair = y[:, i:] + y[:, i:i + 1]
                    pair[:, 0] = y[:, i]  # the dimension alone
                    total[at:at + d - i] += (pair * pair).sum(axis=0).astype(object)
                    at += d - i
                counts[d] = counts.get(d, 0) + len(v)
        yield from _sum_batch(sums, counts)
    return run


def _shifted(v: np.ndarray, mean: list[int]) -> np.ndarray:
    if _bits(v) > 61 or max(map(abs, mean)).bit_length() > 61:
        return v.astype(object) - np.array(mean, dtype=object)
    return v - np.array(mean, dtype=np.int64)


def _extended(m: int, unit: int) -> np.longdouble:
    """m / unit with the precision of a long double."""
    hi = m / unit
    p, q = hi.as_integer_ratio()
    return np.longdouble(hi) + np.longdouble((m * q - p * unit) / (unit * q))


def eigen(moments: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of the symmetric integer matrix over ``unit``: ``eigh``, then two
    steps of simultaneous correction (residuals over differences of eigenvalues) in extended precision."""
    d = len(moments)
    a = np.empty((d, d), dtype=np.longdouble)
    for i in range(d):
        for j in range(i + 1):
            a[i, j] = a[j, i] = _extended(int(moments[i, j]), unit)
    value, vec = np.linalg.eigh(a.astype(np.float64))
    x, norm = vec.astype(np.longdouble), np.abs(value).max(initial=0.0)
    lam = value.astype(np.longdouble)
    for _ in range(2):
        r = np.eye(d, dtype=np.longdouble) - x.T @ x
        s = x.T @ a @ x
        lam = np.diag(s) / (1 - np.diag(r))
        near = 2 * (np.abs(s - np.diag(lam)).max(initial=0) + norm * np.abs(r).max(initial=0))
        gap = lam[None, :] - lam[:, None]
        apart = np.abs(gap) > near
        x = x + x @ np.where(apart, (s + lam[None, :] * r) / np.where(apart, gap, 1), r / 2)
    for _ in range(2):  # vectors of close eigenvalues: orthogonal again, within the space they span
        x = x + x @ ((np.eye(d, dtype=np.longdouble) - x.T @ x) / 2)
    order = np.argsort(-lam, kind="stable")
    lam, x = lam[order], x[:, order]
    lead = np.abs(x).argmax(axis=0)
    return lam, x * np.where(x[lead, np.arange(d)] < 0, -1, 1)


class Whitener:
    """Fit of one length: rows n, integer shift, rest of the sums, eigenvalues and eigenvectors of the covariance, weights."""

    def __init__(self, dims: int, n: int, sums: list[int], squares: dict[int, int]):
        self.n, self.dims = n, dims
        self.shift = [s // n for s in sums]
        self.rest = [s - n * m for s, m in zip(sums, self.shift)]
        centred = {}
        for k, t in squares.items():
            i, j = divmod(k, dims)
            r = self.rest[i] if i == j else self.rest[i] + self.rest[j]
            centred[k] = n * n * t - n * r * r  # sum of (n z - S)^2
        moments = np.empty((dims, dims), dtype=object)
        for i in range(dims):
            moments[i, i] = centred[i * dims + i]
            for j in range(i + 1, dims):
                moments[i, j] = moments[j, i] = (centred[i * dims + j] - centred[i * dims + i] - centred[j * dims + j]) // 2
        trace = sum(int(moments[i, i]) for i in range(dims))
        value, vec = eigen(moments, max(trace, 1))  # in shares of the trace
        k = min(COMPONENTS, dims)
        live = value[:k] > max(float(value[0]), 0.0) * dims * 2.0 ** -52
        self.explained = np.where(live, value[:k], 0).astype(np.float64)
        spread = np.sqrt(np.where(live, value[:k], 1) * _extended(trace, n ** 3))
        self.weights = np.where(live, vec[:, :k] / np.where(live, spread, 1), np.nan).astype(np.float64)
        self.components, self.live = vec[:, :k].astype(np.float64), live
        self.identity_error = 0.0

    def integers(self, v: np.ndarray) -> np.ndarray:
        return _shifted(v, self.shift)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return (y.astype(np.float64) - mean) @ self.weights

    def deviation(self, y: np.ndarray) -> list[int | None]:
        bits = 2 * (self.n.bit_length() + _bits(y) + 1) + self.dims.bit_length() if y.dtype != object else 99
        z = _exact(y, bits) * self.n - np.array(self.rest, dtype=object if bits >= 62 else np.int64)
        return [int(s) if s < 1 << 63 else None for s in (z * z).sum(axis=1)]


def _whitened_products(models):
    """Sums of products of the whitened components, and of the components (k = components^2 + i)."""
    def run(batches):
        import pyarrow as pa
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, d, v in matrices(batch):
                w = models.value[d]
                z = np.nan_to_num(w.whiten(w.integers(v)))
                part = np.concatenate([(z.T @ z).reshape(-1), z.sum(axis=0)])
                sums[d] = sums.get(d, 0) + part
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), d, dtype=np.int32)), pa.array(np.arange(len(s), dtype=np.int64)), pa.array(s)],
                                             names=["dims", "k", "s"])
    return run


def fit(vectors: DataFrame) -> dict[int, Whitener]:
    """A whitener per vector length. ``vectors`` is the result of ``integer_vectors``."""
    spark = spark_of(vectors)
    distinct = stage(vectors.groupBy("dims", "x").agg(F.count(F.lit(1)).alias("rows")), "wh-fit")
    first = _total(distinct.select("dims", "x").mapInArrow(_dimension_sums, _SUMS))
    sums = {d: (n, [s[k] for k in range(d)]) for d, (n, s) in first.items()}
    shift = spark.sparkContext.broadcast({d: [s // n for s in per] for d, (n, per) in sums.items()})
    squares = _total(distinct.select("dims", "x").mapInArrow(_square_sums(shift), _SUMS))
    models = {d: Whitener(d, n, per, squares[d][1]) for d, (n, per) in sums.items()}
    shared = spark.sparkContext.broadcast(models)
    prod = distinct.select("dims", "x").mapInArrow(_whitened_products(shared), "dims int, k long, s double") \
        .groupBy("dims", "k").agg(F.sum("s").alias("s")).toArrow().to_pylist()
    for d, w in models.items():
        k = len(w.explained)
        flat = np.zeros(k * k + k)
        for r in prod:
            if r["dims"] == d:
                flat[r["k"]] = r["s"] / w.n
        cov = flat[:k * k].reshape(k, k) - np.outer(flat[k * k:], flat[k * k:])
        off = np.abs(cov - np.eye(k))[np.ix_(w.live, w.live)]
        w.identity_error = float(off.max(initial=0.0))
    discard(distinct)
    return models


def _apply(models):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for rows, d, v in matrices(batch, most=1 << 18):
                w = models.value[d]
                y = w.integers(v)
                white = w.whiten(y)
                k = white.shape[1]
                dev = pa.array(w.deviation(y), type=pa.int64())
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                flat = white.reshape(-1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(flat), w.n, dtype=np.int64)), dev.take(each), pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(w.explained, len(rows))), pa.array(np.full(len(flat), w.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per whole vector and component."""
    spark = spark_of(embeddings)
    models = fit(integer_vectors(embeddings, vec_id, embedding, SCALE))
    shared = spark.sparkContext.broadcast(models)
    return integer_vectors(embeddings, vec_id, embedding, SCALE).mapInArrow(_apply(shared), OUT)

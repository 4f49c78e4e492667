"""Embedding whitening by incremental eigendecomposition.

Vectors become whole numbers, and each distinct vector counts once; their number and sums are exact. Then every task
keeps the spectrum of its centred vectors: a rank-one update solves the secular equation for all eigenvalues at once,
after deflation of weights that vanish and of eigenvalues that meet. A block of vectors is first turned, by QR, into at most
as many rows with the same scatter as it has dimensions, and each row is one update. Spectra are combined, a bounded
number at a time, by successive rank-one updates with the other spectrum's scaled eigenvectors. Last, tasks project
their centred vectors on the basis found, and the eigenvectors of the summed projected scatter (Rayleigh-Ritz) refine it.

What passes between tasks and the driver are matrices of the dimension's size, never vectors.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
COMPONENTS = 4
BLOCK = 4096
FAN_IN = 8
LARGEST = 1 << 62  # entries beyond it are held there
EPS = np.finfo(float).eps


# ------------------------------------------------------------------ rows

def _valid(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows without nulls and non-finite entries, with the start and length of each in the flat values."""
    off = np.asarray(col.offsets).astype(np.int64)
    values = col.values
    bad = ~np.isfinite(values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)) if len(values) else np.zeros(0, bool)
    n_bad = np.concatenate([[0], np.cumsum(bad)])
    good = np.flatnonzero((n_bad[off[1:]] == n_bad[off[:-1]]) & col.is_valid().to_numpy(zero_copy_only=False))
    return good, off[good], off[good + 1] - off[good]


def _whole(col: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dims`` valid entries, and their whole numbers."""
    good, start, length = _valid(col)
    good, start = good[length == dims], start[length == dims]
    if not len(good):
        return good, np.zeros((0, dims), np.int64)
    values = col.values.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    x = np.floor(SCALE * values[start[:, None] + np.arange(dims)])
    return good, np.clip(x, -float(LARGEST), float(LARGEST)).astype(np.int64)


def _packed(x: np.ndarray):
    """Batches of the rows as bytes, each in the narrowest width that holds it."""
    top = np.maximum(x.max(1, initial=0), -(x.min(1, initial=0) + 1)) if len(x) else np.zeros(0, np.int64)
    width = np.select([top < 1 << 15, top < 1 << 31], [2, 4], 8)
    for w in np.unique(width):
        rows = np.ascontiguousarray(x[width == w].astype(f"<i{w}"))
        off = np.arange(len(rows) + 1, dtype=np.int32) * int(w * x.shape[1])
        yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(rows)])], ["x"])


def _unpacked(col: pa.Array, dims: int):
    """Arrays of whole numbers, BLOCK rows at most, of a column of packed rows."""
    raw = col.to_pylist()
    for w in (2, 4, 8):
        same = [r for r in raw if len(r) == w * dims]
        for i in range(0, len(same), BLOCK):
            yield np.frombuffer(b"".join(same[i:i + BLOCK]), f"<i{w}").reshape(-1, dims).astype(np.int64)


def distinct_vectors(vectors: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """``x`` (packed whole numbers) of each distinct vector, and the dimension.

    The dimension is the length that most valid rows have (the larger one of equals); rows of other lengths are left out."""
    def lengths(batches):
        for b in batches:
            size, n = np.unique(_valid(b.column(0))[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n)], ["size", "n"])

    def pack(batches):
        for b in batches:
            yield from _packed(_whole(b.column(0), dims)[1])

    found = vectors.select(vec_col).mapInArrow(lengths, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n"), F.desc("size")).first()
    dims = int(found["size"]) if found else 0
    if not dims:
        return vectors.sparkSession.createDataFrame([], "x binary"), 0
    return cut(vectors.select(vec_col).mapInArrow(pack, "x binary").distinct(), "white-fit"), dims


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension, without rounding."""
    def add(batches):
        n, total = 0, np.zeros(dims, object)
        for b in batches:
            for x in _unpacked(b.column(0), dims):
                n += len(x)
                total += (x if np.abs(x).max() < 1 << 40 else x.astype(object)).sum(0).astype(object)
        rows = [(-1, Decimal(n)), *((i, Decimal(int(t))) for i, t in enumerate(total))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.decimal128(38, 0))], ["dim", "s"])

    sums = {r.dim: int(r.s) for r in fit.mapInArrow(add, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()}
    return sums.get(-1, 0), [sums.get(i, 0) for i in range(dims)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as whole numbers: 64-bit where they fit, else of any size."""
    top = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0)
    if top < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


# ------------------------------------------------------------------ spectra

def _deflate(lam: np.ndarray, q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turns eigenvectors of eigenvalues that meet so that one of them holds all the weight; the rest, and weights that
    vanish, drop out. Returns the rotated vectors, the weights, and the indexes that stay. ``lam`` rises."""
    tiny = 8 * EPS * max(abs(lam).max(), float(z @ z))
    z, q = z.copy(), q
    turned = False
    last = -1
    for i in np.flatnonzero(np.abs(z) * np.linalg.norm(z) > tiny):
        if last >= 0 and lam[i] - lam[last] <= tiny:
            if not turned:
                q, turned = q.copy(), True
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            q[:, last], q[:, i] = c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]
            z[last], z[i] = 0.0, r
        last = i
    return q, z, np.flatnonzero(np.abs(z) * np.linalg.norm(z) > tiny)


def secular_roots(lam: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_j^2 / (lam_j - mu) for rising, different ``lam`` and nonzero ``z``: for each root the index of the pole next
    to it and the distance from it. All roots move at once, by two-pole interpolation inside a shrinking bracket."""
    d, z2 = len(lam), z * z
    upper = np.append(lam[1:], lam[-1] + z2.sum())
    mid = (lam + upper) / 2
    f_mid = 1 + (z2 / (lam - mid[:, None])).sum(1)
    left = (f_mid >= 0) | (np.arange(d) == d - 1)
    pole = np.where(left, np.arange(d), np.minimum(np.arange(d) + 1, d - 1))
    delta = lam - lam[pole][:, None]              # poles seen from each root's own pole
    far = upper - lam[pole]                       # the right end seen from there
    near = lam - lam[pole]
    half = (upper - lam) / 2
    lo = np.where(left, 0.0, -half)
    hi = np.where(left, np.where(np.arange(d) == d - 1, far, half), 0.0)
    t = (lo + hi) / 2
    below = np.arange(d) <= np.arange(d)[:, None]  # poles at or left of the root
    for _ in range(60):
        gap = delta - t[:, None]
        term = z2 / gap
        psi, phi = np.where(below, term, 0).sum(1), np.where(below, 0, term).sum(1)
        w = 1 + psi + phi
        done = (np.abs(w) <= 4 * EPS * d * (1 + np.abs(psi) + np.abs(phi))) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if done.all():
            break
        lo, hi = np.where(w < 0, t, lo), np.where(w < 0, hi, t)
        with np.errstate(over="ignore"):
            slope = term / gap
        dpsi, dphi = np.where(below, slope, 0).sum(1), np.where(below, 0, slope).sum(1)
        d1, d2 = near - t, far - t
        c = w - d1 * dpsi - d2 * dphi
        a = (d1 + d2) * w - d1 * d2 * (dpsi + dphi)
        b = d1 * d2 * w
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        to = t + step
        inside = np.isfinite(to) & (to > lo) & (to < hi)
        t = np.where(done, t, np.where(inside, to, (lo + hi) / 2))
    return pole, t


def rank_one(lam: np.ndarray, q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (eigenvalues rising) of q diag(lam) q' + y y'."""
    z = q.T @ y
    if z @ z < 1e-250:  # below any whole number's part in a sum
        return lam, q
    q, z, live = _deflate(lam, q, z)
    if not len(live):
        return lam, q
    l, w = lam[live], z[live]
    pole, t = secular_roots(l, w)
    gap = (l - l[pole][:, None]) - t[:, None]                 # lam_j - mu_i
    # weights that belong exactly to the roots found keep the vectors orthogonal
    ratio = -gap / np.where(np.eye(len(l), dtype=bool), 1.0, l - l[:, None])
    exact = np.sqrt(np.abs(np.prod(ratio, 0))) * np.sign(w)
    v = exact / gap
    v /= np.linalg.norm(v, axis=1)[:, None]
    out_l, out_q = lam.copy(), q.copy()
    out_l[live], out_q[:, live] = l[pole] + t, q[:, live] @ v.T
    order = np.argsort(out_l, kind="stable")
    return out_l[order], out_q[:, order]


def add_rows(lam: np.ndarray, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum after a block of centred rows."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    for y in rows:
        lam, q = rank_one(lam, q, y)
    return lam, q


def combined(spectra: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    lam, q = spectra[0]
    for l, v in spectra[1:]:
        for x, y in zip(l, v.T):
            if x > 0:
                lam, q = rank_one(lam, q, np.sqrt(x) * y)
    return lam, q


def _tree(parts: DataFrame, merge, name: str) -> list[bytes]:
    """``part, value`` merged ``FAN_IN`` at a time, in order of part, until one is left."""
    def fold(key, table):
        rows = sorted(zip(table.column("part").to_pylist(), table.column("value").to_pylist()))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([merge([v for _, v in rows])], pa.binary())})

    parts = cut(parts, name)
    top = parts.agg(F.max("part")).first()[0]
    while top:
        parts = cut(parts.groupBy(F.floor(F.col("part") / FAN_IN).cast("long").alias("up")).applyInArrow(fold, "part long, value binary"), name)
        top //= FAN_IN
    return [bytes(r.value) for r in parts.collect()]  # one row


def _sum(values: list[bytes]) -> bytes:
    return sum(np.frombuffer(v) for v in values).tobytes()


def incremental_spectrum(fit: DataFrame, dims: int, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of the scatter of all centred vectors."""
    def run(batches):
        from pyspark import TaskContext
        lam, q, held = np.zeros(dims), np.eye(dims), []
        for b in batches:
            for x in _unpacked(b.column(0), dims):
                held.append(centred(x, n, sums).astype(float) / n)
                if sum(map(len, held)) >= BLOCK:
                    lam, q = add_rows(lam, q, np.concatenate(held))
                    held = []
        if held:
            lam, q = add_rows(lam, q, np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.concatenate([lam, q.ravel()]).tobytes()], pa.binary())],
                                         ["part", "value"])

    def merge(values):
        return np.concatenate([x.ravel() for x in combined([split(v) for v in values])]).tobytes()

    def split(value):
        a = np.frombuffer(value)
        return a[:dims].copy(), a[dims:].reshape(dims, dims).copy()

    return split(_tree(fit.mapInArrow(run, "part long, value binary"), merge, "white-spectra")[0])


def projected_scatter(fit: DataFrame, basis: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Scatter matrix and sums of the centred vectors' coordinates in ``basis`` (columns)."""
    dims, k = basis.shape

    def run(batches):
        from pyspark import TaskContext
        out = np.zeros((k + 1, k))
        for b in batches:
            for x in _unpacked(b.column(0), dims):
                y = centred(x, n, sums).astype(float) / n @ basis
                out[:k] += y.T @ y
                out[k] += y.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["part", "value"])

    out = np.frombuffer(_tree(fit.mapInArrow(run, "part long, value binary"), _sum, "white-scatter")[0]).reshape(k + 1, k)
    return out[:k], out[k]


def refined(fit: DataFrame, basis: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz on the whole basis: eigenvalues of the covariance, falling, and unit eigenvectors (largest entry positive)."""
    basis, _ = np.linalg.qr(basis)
    h, _ = projected_scatter(fit, basis, n, sums)
    e, u = np.linalg.eigh((h + h.T) / 2)
    vectors = basis @ u[:, ::-1]
    vectors /= np.linalg.norm(vectors, axis=0)
    return e[::-1] / n, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each valid row and component.

    Rows whose vector is null, holds null or non-finite entries, or has another length than most, are left out; repeated rows
    and ids each get their rows, and count once in the fit. Entries beyond 2^62 / 256 are held there. A direction without
    variance whitens to 0 and does not count in identity_error; a deviation beyond 64 bits is null. No valid row: no rows."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = vectors.select(id_col, vec_col)
    fit, dims = distinct_vectors(vectors, vec_col)
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums = exact_sums(fit, dims)
    _, basis = incremental_spectrum(fit, dims, n, sums)
    values, basis = refined(fit, basis, n, sums)
    k, trace = min(components, dims), float(np.maximum(values, 0).sum())
    live = values[:k] > dims * EPS * trace
    basis, scale = basis[:, :k], np.where(live, 1 / np.sqrt(np.where(live, values[:k], 1)), 0.0)
    explained = np.maximum(values[:k], 0) / trace if trace else np.zeros(k)
    h, total = projected_scatter(fit, basis, n, sums)
    off = (h / n - np.outer(total, total) / n / n) * np.outer(scale, scale) - np.diag(live.astype(float))
    error = float(np.abs(off).max())

    def project(batches):
        for b in batches:
            good, x = _whole(b.column(1), dims)
            for i in range(0, len(good), BLOCK):
                d = centred(x[i:i + BLOCK], n, sums)
                w = d.astype(float) / n @ basis * scale
                small = d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * dims < 1 << 63
                dev = (d * d).sum(1) if small else [v if v < 1 << 63 else None for v in (sum(int(y) ** 2 for y in r) for r in d)]
                m = len(d)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(np.repeat(good[i:i + BLOCK], k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)), pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(project, schema)


def op12(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    return whiten(vectors)

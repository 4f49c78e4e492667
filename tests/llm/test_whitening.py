import math

import numpy as np
import pytest

from docweave.llm.queries import QUERIES
from docweave.llm.whitening import add_rows, combined, op12, rank_one, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def frame_of(spark, rows, parts=3, kind=SCHEMA):
    rows = [(i, v, 1, "x", 2) for i, v in rows]
    return spark.createDataFrame(rows, kind).repartition(parts) if rows else spark.createDataFrame([], kind)


def check(rows, got, k=4):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max({len(v) for _, v in kept}, key=lambda d: (sum(len(v) == d for _, v in kept), d))
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in kept if len(v) == dims]
    fit = sorted({v for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    scatter = [[sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit) for j in range(dims)] for i in range(dims)]
    cov = np.array([[float(x) for x in r] for r in scatter]) / float(n) ** 3
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, dims)
    assert len(got) == len(kept) * k
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c in range(1, k + 1):
        part = sorted(by[c], key=lambda r: (r.vec_id is None, r.vec_id, r.deviation, r.whitened))
        dev = sorted((i is None, i, sum((n * x - s) ** 2 for x, s in zip(v, sums))) for i, v in kept)
        assert [(r.vec_id is None, r.vec_id, r.deviation) for r in part] == dev
        if e[c - 1] > 1e-12 * e.sum():
            assert abs(part[0].explained - e[c - 1] / e.sum()) <= 1e-9
            gap = min([abs(e[c - 1] - x) for j, x in enumerate(e) if j != c - 1] or [1])
            if gap > 1e-3 * e[0]:
                want = sorted((i is None, i, (np.array(v) - np.array(sums) / n) @ u[:, c - 1] / math.sqrt(e[c - 1])) for i, v in kept)
                byid = sorted(((r.vec_id is None, r.vec_id, r.whitened) for r in part))
                flip = sorted(((a, b, -w) for a, b, w in byid))
                near = lambda xs: all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-7 for x, y in zip(xs, want))
                assert near(byid) or near(flip)
        else:
            assert {r.whitened for r in part} == {0.0}
    # whitened coordinates of the fit list have the identity as covariance
    live = [c for c in range(1, k + 1) if e[c - 1] > 1e-12 * e.sum()]
    w = {}
    for c in live:
        for r in by[c]:
            w.setdefault((r.vec_id, r.deviation), {})[c] = r.whitened
    return w


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(300, 6)) * [5, 3, 2, 1, 0.3, 0.1] + [1, -2, 0, 0, 9, 0]
    out = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    out += [(1000 + i, out[7][1]) for i in range(150)]           # a group of copies
    out += [(None, out[3][1]), (None, out[4][1]), (5, out[5][1]), (5, None), (6, [None, 1.0, 1.0, 1.0, 1.0, 1.0])]
    out += [(8, [float("nan")] * 6), (9, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (10, [1.0, 2.0]), (11, []), (12, [-0.0] * 6)]
    return out


def test_against_plain_eigenvectors(spark, rows):
    check(rows, op12(frame_of(spark, rows)).collect())


def test_more_parts_than_are_merged_at_once(spark, rows):
    check(rows, op12(frame_of(spark, rows, 30)).collect())


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0]], [[1.0, 2.0]] * 3 + [[2.0, 4.0]], [[0.0], [1.0], [5.0]], [[1.0, 1.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]]])
def test_few_vectors_and_directions_without_variance(spark, vectors):
    rows = list(enumerate(vectors))
    check(rows, op12(frame_of(spark, rows)).collect())


def test_large_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0]), (4, [1e9, 0.0])]
    got = op12(frame_of(spark, rows)).collect()
    assert len(got) == 8 and {r.deviation for r in got if r.vec_id == 1} == {None}
    assert all(math.isfinite(r.whitened) for r in got)


def test_empty(spark):
    assert op12(frame_of(spark, [])).collect() == []
    assert op12(frame_of(spark, [(1, None), (2, [float("nan")]), (3, [])])).collect() == []


def test_doubles_and_more_components(spark, rows):
    kind = SCHEMA.replace("array<float>", "array<double>")
    df = frame_of(spark, [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], kind=kind)
    check(rows, whiten(df, 6).collect(), 6)


@pytest.mark.parametrize("lam", [np.zeros(8), np.ones(8), np.arange(8.0), np.array([0, 0, 0, 1, 1, 1 + 1e-15, 5, 5.0]), np.array([0, 1e-12, 1e-8, 1e-3, 1, 1e3, 1e8, 1e12])])
def test_rank_one_updates(lam):
    rnd = np.random.default_rng(1)
    q, _ = np.linalg.qr(rnd.normal(size=(8, 8)))
    for y in (rnd.normal(size=8), q[:, 2] * 3, q[:, 0] + 1e-9 * q[:, 5], np.zeros(8), 1e-160 * np.ones(8), 1e4 * rnd.normal(size=8)):
        a = q @ np.diag(lam) @ q.T + np.outer(y, y)
        l, v = rank_one(lam, q, y)
        size = max(1e-300, np.abs(a).max())
        assert (np.diff(l) >= 0).all() and np.abs(v.T @ v - np.eye(8)).max() < 1e-12
        assert np.abs(v @ np.diag(l) @ v.T - a).max() < 1e-12 * size
        assert np.abs(l - np.linalg.eigvalsh(a)).max() < 1e-12 * size


def test_blocks_and_merges():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, 12)) @ np.diag(10.0 ** -np.arange(12))
    whole = add_rows(np.zeros(12), np.eye(12), x)
    parts = combined([add_rows(np.zeros(12), np.eye(12), p) for p in np.array_split(x, 7)])
    single = (np.zeros(12), np.eye(12))
    for y in x:
        single = rank_one(*single, y)
    want = np.linalg.eigvalsh(x.T @ x)
    for l, v in (whole, parts, single):
        assert np.abs(l - want).max() < 1e-10 * want[-1] and np.abs(v.T @ v - np.eye(12)).max() < 1e-10


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").limit(120).collect()]
    check(rows, op12(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    full = QUERIES["op12_whitening"](spark, d).collect()
    assert len(full) == 4 * spark.read.parquet(f"{d}/embeddings.parquet").count() and full[0].identity_error < 1e-9

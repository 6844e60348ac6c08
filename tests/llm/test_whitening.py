"""Whitening against a full decomposition, and the solver on hard matrices."""

import math

import numpy as np
import pytest

from sparkproof.llm import whitening

SF = "/root/testdata/sf0.001"


def vectors_of(rows):
    """Rows that stay, in whole numbers, by brute force."""
    whole = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    sizes = {}
    for _, v in whole:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    dims = max(sizes, key=lambda k: (sizes[k], k), default=0)
    return [(i, tuple(math.floor(256 * float(e)) for e in v)) for i, v in whole if len(v) == dims]


def check(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], f"vec_id long, embedding {kind}, component string, n int")
    got = whitening.whiten(df).collect()
    if kind == "array<float>":
        rows = [(i, v and [e if e is None else float(np.float32(e)) for e in v]) for i, v in rows]
    want = vectors_of(rows)
    fit = np.array(sorted({v for _, v in want}), float)
    n, dims = fit.shape
    sums = [sum(int(v) for v in column) for column in fit.T]
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / n
    values, vectors = (x[..., ::-1] for x in np.linalg.eigh(cov))
    k = min(4, dims)
    assert len(got) == len(want) * k and {r.n for r in got} <= {n}
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert {key for key in found} == {(i, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in want}
    for component in range(1, k + 1):
        e = values[component - 1]
        mine = {(r.vec_id, r.deviation): r for r in got if r.component == component}
        if e < 1e-9 * max(values[0], 1):
            assert all(r.whitened is None for r in mine.values())
            continue
        theirs = {
            (i, sum((n * a - s) ** 2 for a, s in zip(v, sums))): (np.array(v) - fit.mean(axis=0)) @ vectors[:, component - 1] / e**0.5
            for i, v in want
        }
        a = np.array([mine[key].whitened for key in sorted(mine, key=repr)])
        b = np.array([theirs[key] for key in sorted(mine, key=repr)])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(abs(r.explained - e / np.trace(cov)) < 1e-12 and r.identity_error < 1e-10 for r in mine.values())
    return got


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(spark, [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(7).tolist()) for i in range(300)]
    rows += [(1, rows[0][1])] * 200 + [(None, rows[1][1]), (None, None), (5, []), (6, [1.0] * 3), (7, [None] * 7), (8, None)]
    rows += [(9, [math.nan] + [0.0] * 6), (10, [math.inf] + [0.0] * 6), (11, [-math.inf] * 7), (12, [-0.0] * 7), (13, [0.0] * 7)]
    check(spark, rows)
    check(spark, rows, "array<double>")


@pytest.mark.parametrize("rows", [
    [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, [3.0]), (2, [4.0]), (3, [9.0])],
    [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [0.0, 0.0, 0.0])],
])
def test_few_rows_and_dimensions(spark, rows):
    check(spark, rows)


def test_no_rows(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    out = whitening.whiten(df)
    assert out.collect() == [] and out.columns == [f.name for f in whitening.OUT]


def test_great_values(spark):
    """Whole numbers beyond 2^53, and deviations beyond a long."""
    rows = [(1, [2.0**50, 1.0]), (2, [0.0, 2.0]), (3, [-(2.0**49), 0.0]), (4, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert all(r.deviation is None for r in got) and {r.n for r in got} == {4}
    small = spark.createDataFrame([(1, [2.0**20, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(small).collect()} == {2 ** 56 + 2 * 128**2 * 2}


Q = np.linalg.qr(np.random.default_rng(0).standard_normal((64, 64)))[0]
HARD = {
    "close": 1 + 1e-6 * np.arange(64), "equal": np.array([5.0] * 5 + [1.0] + [0.0] * 58), "zero": np.zeros(64), "one": np.ones(64),
    "steep": 1e9 * 0.1 ** np.arange(64.0), "below": -np.arange(64.0),
}


@pytest.mark.parametrize("name", HARD)
def test_solver(name):
    a = Q @ np.diag(HARD[name]) @ Q.T
    passes = []
    values, vectors = whitening.leading_pairs(lambda v: passes.append(1) or a @ v, 64, 4)
    norm = np.abs(HARD[name]).max()
    assert np.abs(values - np.sort(HARD[name])[::-1][:4]).max() <= 1e-13 * norm
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13 and len(passes) < 250


def test_minres_solves_projected_systems():
    rng = np.random.default_rng(1)
    b = rng.standard_normal((20, 20))
    a, shifts = b + b.T, np.array([0.3, -2.0])
    guard = np.linalg.qr(rng.standard_normal((20, 2)))[0]
    project = lambda z: z - guard @ (guard.T @ z)
    right = project(rng.standard_normal((20, 2)))
    t = whitening.minres(lambda v: a @ v, project, shifts, right, 60, np.zeros(2))
    assert np.abs(project(a @ t - t * shifts) - right).max() < 1e-6 and np.abs(guard.T @ t).max() < 1e-9

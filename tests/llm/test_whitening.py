import math

import numpy as np
import pytest

from hearth.llm import whitening
from hearth.llm.queries import op12_whitening

from .conftest import fixture


def rotation(rng, n):
    return np.linalg.qr(rng.normal(size=(n, n)))[0]


def matrices():
    rng = np.random.default_rng(0)
    a, b = rotation(rng, 30), rotation(rng, 30)
    return {
        "random": rng.normal(size=(40, 40)), "of many rows": np.linalg.qr(rng.normal(size=(5000, 64)), mode="r"),
        "identity": np.eye(9), "diagonal with ties": np.diag([3.0, 3, 3, 2, 2, 1, 0, 0]),
        "ties": a @ np.diag([5.0] * 10 + [2.0] * 10 + [1.0] * 10) @ b, "graded": a @ np.diag(np.logspace(0, -14, 30)) @ b,
        "deficient": a @ np.diag([1.0] * 15 + [0.0] * 15) @ b, "one": np.array([[-2.0]]), "two": rng.normal(size=(2, 2)),
        "almost equal pairs": np.diag(np.abs(np.arange(21.0) - 10) + 1) + np.diag(np.ones(20), 1),
        "zero": np.zeros((3, 3)), "far apart": np.diag([1e8, 1.0, 1e-8]) + np.diag([1e7, 0.1], 1),
    }


@pytest.mark.parametrize("name", matrices())
def test_solver_against_svd(name):
    a = matrices()[name]
    s, v = whitening.right_singular(a)
    want = np.linalg.svd(a, compute_uv=False)
    top = max(want[0], 1e-300)
    assert np.abs(s - want).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(len(a))).max() < 1e-11
    assert np.abs(a.T @ (a @ v) - v * s ** 2).max() <= 1e-12 * top ** 2


def test_small_values_are_relatively_accurate():
    """A bidiagonal fixes its singular values to high relative accuracy, however small."""
    from fractions import Fraction
    d, e = [1.0, 1e-3, 1e-6, 1e-9], [1.0, 1e-3, 1e-6]
    s = whitening.singular_values(np.array(d), np.array(e))
    product = math.prod(Fraction(x) for x in d)
    assert abs(math.prod(Fraction(float(x)) for x in s) / product - 1) < 1e-13


def brute(rows, limit=32):
    """Rows of the contract by plain integers and a dense eigenvalue solver."""
    whole = [(k, v) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in whole], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = ((n * x - s) ** 2).sum(axis=1)
    y = (n * x - s).astype(float) / n
    e, axes = np.linalg.eigh(y.T @ y / n)
    e, axes = e[::-1], axes[:, ::-1]
    return [k for k, _ in whole], n, dev, y, e, axes


def test_query_against_dense_solver(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 40)) @ np.diag(np.linspace(3, 0.2, 40)) + 50
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (900, None), (901, [None] + rows[0][1][1:]), (902, [math.nan] + rows[0][1][1:]),
             (903, [math.inf] + rows[0][1][1:]), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, label int, n long, component string")
    got = op12_whitening(spark, fixture(spark, tmp_path, "embeddings", df.repartition(5))).toPandas()
    keys, n, dev, y, e, axes = brute([r for r in rows if r[0] not in (904, 905)])
    assert len(got) == 32 * n and set(got.n) == {n}
    assert sorted(got.component.unique()) == list(range(1, 33))
    first = got[got.component == 1]
    assert sorted(map(str, first.deviation)) == sorted(map(str, dev))
    assert (got.identity_error == got.identity_error[0]).all() and got.identity_error[0] < 1e-10
    for c in range(1, 33):
        part = got[got.component == c].dropna().set_index("vec_id")
        assert np.allclose(part.explained, e[c - 1] / e.sum(), rtol=1e-9)
        want = y @ axes[:, c - 1] / math.sqrt(e[c - 1])
        want = {k: w for k, w in zip(keys, want) if k is not None and k != 5}
        mine = np.array([part.whitened[k] for k in want])
        want = np.array(list(want.values()))
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8


def test_rank_deficient_and_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, size=(60, 3)) / 64.0
    x = np.concatenate([x, x[:, :1], np.ones((60, 2))], axis=1)  # three spreads at most
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    fitted = whitening.fit(df)
    assert len(fitted.values) == 3 and fitted.identity_error < 1e-12
    square = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])],
                                   "vec_id long, embedding array<double>")
    fitted = whitening.fit(square)
    assert np.allclose(fitted.explained, [0.5, 0.5]) and fitted.identity_error < 1e-12


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)  # equal vectors have no spread
    for df in (one.limit(0), one, spark.createDataFrame([(1, None), (2, []), (3, [math.nan]), (4, [1e30])], schema)):
        out = whitening.components(df)
        assert out.count() == 0
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_float_precision():
    y = np.array([[2 ** 31 + 1, 3], [2 ** 40, 0], [0, 0]])
    assert whitening._deviation(y) == [(2 ** 31 + 1) ** 2 + 9, None, 0]

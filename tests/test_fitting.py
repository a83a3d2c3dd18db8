import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.operators import fitting as M


def feature_df(spark, x, y, parts=3):
    rows = [(i, x[i].astype(float).tolist(), int(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, f array<double>, label int").repartition(parts)


def test_lstsq_matches_numpy_pinv(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(120, 7)), rng.integers(0, 3, size=120)
    w = M.fit_lstsq(feature_df(spark, x, y), "f", "label", 3)
    want = (np.linalg.pinv(x) @ np.eye(3)[y]).T
    assert np.allclose(w, want, atol=1e-8)


def test_rank_deficient_minimum_norm(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    x = np.concatenate([x, x[:, :1]], axis=1)   # duplicate column
    y = rng.integers(0, 3, size=40)
    w = M.fit_lstsq(feature_df(spark, x, y), "f", "label", 3)
    assert np.isfinite(w).all()
    assert np.allclose(w, (np.linalg.pinv(x) @ np.eye(3)[y]).T, atol=1e-8)
    assert np.allclose(w[:, 0], w[:, 4])        # minimum norm splits the weight evenly


def test_fewer_rows_than_features(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(6, 10)), rng.integers(0, 2, size=6)
    w = M.fit_lstsq(feature_df(spark, x, y), "f", "label", 2)
    assert np.allclose(x @ w.T, np.eye(2)[y], atol=1e-8)   # interpolates


def test_gram_grouped_per_view(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 2, size=50)
    df = feature_df(spark, x, y).withColumn("view", (F.col("id") % 2).cast("string"))
    heads = M.fit_lstsq(df, "f", "label", 2, group="view")
    for g in ("0", "1"):
        idx = np.arange(50)[np.arange(50) % 2 == int(g)]
        want = (np.linalg.pinv(x[idx]) @ np.eye(2)[y[idx]]).T
        assert np.allclose(heads[g], want, atol=1e-8)


def test_unlabelled_rows_ignored_and_bad_label_raises(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], None), (2, [0.0, 1.0], 1)],
                               "id long, f array<double>, label int")
    w = M.fit_lstsq(df, "f", "label", 2)
    assert np.allclose(w, np.eye(2))
    bad = spark.createDataFrame([(0, [1.0], 5)], "id long, f array<double>, label int")
    with pytest.raises(Exception):
        M.fit_lstsq(bad, "f", "label", 2)


def test_softmax_head_separates(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, size=90)
    x = np.eye(3)[y] * 4 + rng.normal(scale=0.1, size=(90, 3))
    model = M.fit_softmax_head(feature_df(spark, x, y), "f", "label", max_iter=50)
    w, b = M.softmax_head_weights(model)
    assert w.shape == (3, 3) and b.shape == (3,)
    assert ((x @ w.T + b).argmax(1) == y).mean() == 1.0


def test_null_vectors_and_elements_left_out(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, None, 1), (2, [None, 5.0], 1), (3, [0.0, 1.0], 1)],
                               "id long, f array<double>, label int")
    assert np.allclose(M.fit_lstsq(df, "f", "label", 2), np.eye(2))


def test_mapped_heads_equal_heads_on_mapped_rows(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 6)), rng.integers(0, 3, size=60)
    maps = {"view": np.eye(6)[2:5], "fused": rng.normal(size=(4, 6))}
    heads = M.fit_mapped_heads(feature_df(spark, x, y), "f", "label", 3, maps)
    for name, m in maps.items():
        want = (np.linalg.pinv(x @ m.T) @ np.eye(3)[y]).T @ m
        assert np.allclose(heads[name], want, atol=1e-8)


def test_rounds_continue_and_lower_the_loss(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, size=80)
    x = np.eye(3)[y] + rng.normal(scale=0.5, size=(80, 3))
    df = feature_df(spark, x, y).cache()
    (w1, b1), (w2, b2) = M.fit_rounds(df, "f", "label", 3, (2, 3))
    (w5, b5), = M.fit_rounds(df, "f", "label", 3, (5,))
    assert np.allclose(w2, w5) and np.allclose(b2, b5)   # 2 steps and 3 more are 5 steps

    def loss(w, b):
        z = x @ w.T + b
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(80), y]).mean()
    assert loss(w2, b2) < loss(w1, b1) < np.log(3)


def test_rounds_reach_the_regularised_optimum(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(40, 2)), rng.integers(0, 2, size=40)
    df = feature_df(spark, x, y, parts=1).cache()
    (w, b), = M.fit_rounds(df, "f", "label", 2, (25,), reg=0.1)
    full = np.concatenate([w, b[:, None]], axis=1)
    grad, n = M.softmax_gradient(df, "f", "label", full)
    assert n == 40 and np.abs(grad / n + 0.1 * full).max() < 1e-6


def test_no_key_receives_one_row_per_task(spark):
    """The partial sums meet per slot first, so the Gram plan has two exchanges."""
    df = spark.range(8).selectExpr("array(double(id), 1D) AS f", "int(id % 2) AS label")
    plan = M.gram_rows(df, "f", "label", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "slot" in plan


def ill_conditioned(rng, n, d, condition):
    u, _ = np.linalg.qr(rng.normal(size=(n, d)))
    v, _ = np.linalg.qr(rng.normal(size=(d, d)))
    return u @ np.diag(np.logspace(0, -np.log10(condition), d)) @ v.T


@pytest.mark.parametrize("condition,tolerance", [(1e3, 1e-10), (1e7, 1e-8), (1e9, 1e-6)])
def test_condition_is_not_squared(spark, condition, tolerance):
    rng = np.random.default_rng(7)
    x, y = ill_conditioned(rng, 300, 8, condition), rng.integers(0, 3, size=300)
    w = M.fit_lstsq(feature_df(spark, x, y, parts=7), "f", "label", 3)
    want = (np.linalg.pinv(x) @ np.eye(3)[y]).T
    assert np.abs(w - want).max() / np.abs(want).max() < tolerance
    if condition == 1e7:  # what the Gram matrix of the same rows gives
        gram = (np.linalg.pinv(x.T @ x, hermitian=True) @ x.T @ np.eye(3)[y]).T
        assert np.abs(gram - want).max() / np.abs(want).max() > 1e-5


def test_mapped_heads_match_pinv_of_mapped_rows(spark):
    rng = np.random.default_rng(8)
    x, y = ill_conditioned(rng, 200, 9, 1e5), rng.integers(0, 3, size=200)
    m = rng.normal(size=(4, 9))
    w = M.fit_mapped_heads(feature_df(spark, x, y), "f", "label", 3, {"m": m})["m"]
    want = (np.linalg.pinv(x @ m.T) @ np.eye(3)[y]).T @ m
    assert np.abs(w - want).max() / np.abs(want).max() < 1e-8


def test_many_groups_are_solved_on_the_executors(spark):
    groups = 10_000
    df = spark.range(6 * groups).selectExpr(
        "cast(id % 10000 as string) AS g", "array(cast(id % 7 as double), cast(id % 11 as double) / 3) AS f", "cast(id % 3 as int) AS label")
    heads = M.fit_lstsq_groups(df, "f", "label", 3, "g")
    assert heads.count() == 3 * groups
    got = {(r["grp"], r["class"]): r["w"] for r in heads.where("grp in ('0', '77', '9999')").collect()}
    for g in (0, 77, 9999):
        i = np.arange(g, 6 * groups, groups)
        want = np.linalg.pinv(np.stack([i % 7, (i % 11) / 3], axis=1).astype(float)) @ np.eye(3)[i % 3]
        assert np.allclose([got[str(g), c] for c in range(3)], want.T, atol=1e-8)
    with pytest.raises(ValueError):
        M.fit_lstsq(df, "f", "label", 3, group="g")


def test_null_group_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 0), (None, [0.0, 2.0], 1), ("a", [3.0, 0.0], 1), ("a", None, 0), ("b", [1.0, 1.0], None)],
                               "g string, f array<double>, label int")
    got = {(r["grp"], r["class"]): [round(v, 9) for v in r["w"]] for r in M.fit_lstsq_groups(df, "f", "label", 2, "g").collect()}
    assert got == {(None, 0): [1.0, 0.0], (None, 1): [0.0, 0.5], ("a", 0): [0.0, 0.0], ("a", 1): [round(1 / 3, 9), 0.0]}
    assert M.fit_lstsq_groups(df.limit(0), "f", "label", 2, "g").count() == 0
    with pytest.raises(ValueError):
        M.fit_lstsq(df.limit(0), "f", "label", 2)

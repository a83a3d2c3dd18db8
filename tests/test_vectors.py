import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.operators import vectors as V


def vecs(spark):
    return spark.createDataFrame([(1, [1.0, 2.0], [10.0, 20.0], [0.5, 0.5]),
                                  (2, [3.0, 4.0], [30.0, 40.0], [1.0, 1.0])],
                                 "id long, a array<double>, b array<double>, c array<double>")


def test_vec_sum_and_concat(spark):
    d = V.vec_concat(V.vec_sum(vecs(spark), ["a", "b", "c"], "s"), ["a", "c"], "cat", widths=[2, 2])
    rows = {r.id: r for r in d.collect()}
    assert rows[1].s == [11.5, 22.5] and rows[2].cat == [3.0, 4.0, 1.0, 1.0]


def test_width_mismatch_raises(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0], [1.0])], "id long, a array<double>, b array<double>")
    with pytest.raises(Exception):
        V.vec_sum(d, ["a", "b"], "s").collect()
    with pytest.raises(Exception):
        V.vec_concat(d, ["a", "b"], "c", widths=[2, 2]).collect()


def test_pool_first_by_order(spark):
    d = spark.createDataFrame([(1, 2, "late"), (1, 0, "first"), (1, 1, "mid"), (2, 5, "only")],
                              "seq long, pos long, v string")
    out = {r.seq: r.first for r in V.pool_first(d, "seq", "pos", "v").collect()}
    assert out == {1: "first", 2: "only"}


def test_one_hot_and_views(spark):
    d = spark.createDataFrame([(1, list(map(float, range(8))), 2)], "id long, x array<double>, y int")
    r = V.one_hot(d, "y", 4).collect()[0]
    assert r.one_hot == [0.0, 0.0, 1.0, 0.0]
    views = {r.view: r.vec for r in V.layer_views(d, "x", 2, 4, keep=["id"]).collect()}
    assert views == {1: [0.0, 1.0], 2: [2.0, 3.0], 3: [4.0, 5.0], 4: [6.0, 7.0]}
    assert V.view_pick(d, "x", 3, 2).collect()[0].view == [4.0, 5.0]


def test_shape_profile_counts_nulls(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id long, x array<double>")
    r = V.shape_profile(d, ["x"]).collect()[0]
    assert (r.n_rows, r.n_null, r.min_len, r.max_len) == (3, 1, 1, 2)


def test_fold_affine_width_check():
    with pytest.raises(ValueError):
        V.fold_affine([(np.ones((3, 4)), None), (np.ones((2, 5)), None)])


def test_first_of_sequence_and_flatten(spark):
    d = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [])],
                              "id long, h array<array<double>>")
    got = {r.id: r.first for r in V.first_of_sequence(d, "h").collect()}
    assert got == {1: [1.0, 2.0], 2: None}
    flat = V.flatten_rows(d, "h", "vec").collect()
    assert [(r.id, r.pos, r.vec) for r in flat] == [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])]


def test_null_vectors_give_null(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0, 1.0], [2.0, 2.0])],
                              "id long, a array<double>, b array<double>")
    s = {r.id: r.s for r in V.vec_sum(d, ["a", "b"], "s").collect()}
    assert s == {1: None, 2: [3.0, 3.0]}
    c = {r.id: r.c for r in V.vec_concat(d, ["a", "b"], "c", widths=[2, 2]).collect()}
    assert c[1] is None and c[2] == [1.0, 1.0, 2.0, 2.0]
    p = {r.id: r.y for r in V.project(d, "b", [[1.0, 1.0]], out="y").collect()}
    assert p == {1: None, 2: [4.0]}


def test_null_elements_give_null_on_both_projection_routes(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, 4.0],), (None,), ([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    for k in (3, 80):
        got = [r.p for r in V.project(df, "x", np.ones((k, 4)), out="p").collect()]
        assert got == [None, None, [10.0] * k]

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearth.operators import metrics as A
from hearth.operators import scoring as R
from hearth.operators import vectors as V


def logits_df(spark, rows):
    return spark.createDataFrame(rows, "id long, logits array<double>, label int")


def test_argmax_ties_go_to_first(spark):
    df = logits_df(spark, [(1, [1.0, 3.0, 3.0], 1), (2, [2.0, 2.0, 2.0], 0)])
    out = {r.id: r.pred for r in R.score(df, "logits").collect()}
    assert out == {1: 1, 2: 0}


def test_never_seen_class_counts_as_wrong(spark):
    # labels only 0/1, best logit at class 2: argmax is over all classes
    df = logits_df(spark, [(1, [0.0, 1.0, 5.0], 1), (2, [0.0, 1.0, 5.0], 0)])
    m = A.evaluate(R.score(df, "logits", label="label")).collect()[0]
    assert m.accuracy == 0.0 and m.n_correct == 0 and m.n_labelled == 2


def test_large_logits_stay_finite(spark):
    df = logits_df(spark, [(1, [1000.0, 0.0], 0), (2, [0.0, 1000.0], 0)])
    rows = {r.id: r for r in R.score(df, "logits", label="label", probabilities=True).collect()}
    assert rows[1].score == pytest.approx(1.0)
    assert all(math.isfinite(p) for p in rows[1].probs)
    assert rows[1].nll == pytest.approx(0.0, abs=1e-12)
    assert rows[2].nll == pytest.approx(1000.0)


def test_unlabelled_row_scored_but_not_in_metric(spark):
    df = logits_df(spark, [(1, [0.0, 2.0], 1), (2, [3.0, 0.0], None), (3, [3.0, 0.0], 1)])
    scored = R.score(df, "logits", label="label")
    assert scored.filter("pred is null").count() == 0
    m = A.evaluate(scored).collect()[0]
    assert (m.n_labelled, m.n_unlabelled, m.n_correct) == (2, 1, 1)
    assert m.accuracy == pytest.approx(0.5)


def test_nan_rejected_in_strict_mode(spark):
    df = logits_df(spark, [(1, [float("nan"), 0.0], 0)])
    with pytest.raises(Exception):
        R.score(df, "logits", strict=True).collect()


def test_class_names_and_strict_unknown(spark):
    df = logits_df(spark, [(1, [0.0, 1.0, 5.0], 0)])
    r = R.score(df, "logits", class_names={0: "neg", 1: "pos", 2: "neu"}).collect()[0]
    assert r.pred_name == "neu"
    with pytest.raises(Exception):
        R.score(df, "logits", class_names={0: "neg", 1: "pos"}, strict=True).collect()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.floats(-50, 50), min_size=3, max_size=3), min_size=1, max_size=20))
def test_softmax_properties(spark, rows):
    df = logits_df(spark, [(i, r, 0) for i, r in enumerate(rows)])
    for r in R.score(df, "logits", probabilities=True).collect():
        assert sum(r.probs) == pytest.approx(1.0)
        # softmax is monotone: the arg-max class has the largest probability (logits
        # closer than rounding can tie in probability, so compare values, not indices)
        assert r.pred == int(np.argmax(r.logits))
        assert r.probs[r.pred] == max(r.probs)
        assert r.score == pytest.approx(max(r.probs))


def test_folded_chain_equals_unfolded(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 6))
    w1, b1 = rng.normal(size=(5, 6)), rng.normal(size=5)
    w2, b2 = rng.normal(size=(3, 5)), rng.normal(size=3)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "id long, x array<double>")
    got = {r.id: r.logits for r in R.head_logits(df, "x", [(w1, b1), (w2, b2)]).collect()}
    want = (x @ w1.T + b1) @ w2.T + b2
    for i in range(20):
        assert np.allclose(got[i], want[i], atol=1e-9)


def test_wide_projection_arrow_matches_jvm(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 80))
    w = rng.normal(size=(70, 80))  # 5,600 weights: Arrow path
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "id long, x array<double>")
    wide = {r.id: r.y for r in V.project(df, "x", w, out="y").collect()}
    small = {r.id: r.y for r in V.project(df, "x", w[:40, :80][:50], out="y").collect()}
    for i in range(30):
        assert np.allclose(wide[i], x[i] @ w.T, atol=1e-9)
        assert np.allclose(small[i], x[i] @ w[:40].T, atol=1e-9)


def test_projection_width_mismatch_raises(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, x array<double>")
    with pytest.raises(Exception):
        V.project(df, "x", np.ones((2, 3))).collect()


def test_classify_struct_and_score_with_fn(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, x array<double>")

    def make():
        w = np.array([[2.0, 0.0], [0.0, 2.0], [1.0, 1.0]])
        return lambda feats: feats["x"] @ w.T

    lg = R.score_with_fn(df, make, ["x"], 3, keep=["id"])
    out = {r.id: r.result for r in R.classify_struct(lg, "logits", ["a", "b", "c"]).collect()}
    assert out[1].label == "a" and out[2].label == "b"
    assert 0.33 < out[1].score < 1.0


def test_compare_results(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2)], "old int, new int")
    summary, confusion = A.compare_results(df, "old", "new")
    s = summary.collect()[0]
    assert (s.n_rows, s.n_agree) == (3, 2)
    assert confusion.count() == 3


def test_missing_prediction_counts_as_wrong(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, None, 0)], "id long, pred int, label int")
    m = A.evaluate(df, nll=None).collect()[0]
    assert (m.n_labelled, m.n_correct) == (2, 1) and m.accuracy == pytest.approx(0.5)


def test_score_with_fn_null_inputs_give_null(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, x array<double>")

    def make():
        return lambda feats: feats["x"] @ np.eye(2)

    out = {r.id: r.logits for r in R.score_with_fn(df, make, ["x"], 2, keep=["id"]).collect()}
    assert out == {1: [1.0, 0.0], 2: None}


def test_ignored_and_wrong_labels(spark):
    df = spark.createDataFrame([([0.0, 1.0], 1), ([0.0, 1.0], -100), ([0.0, 1.0], None)], "logits array<double>, y int")
    got = [r.nll for r in R.score(df, "logits", "y").collect()]
    assert got[0] is not None and got[1] is None and got[2] is None
    bad = spark.createDataFrame([([0.0, 1.0], -2)], "logits array<double>, y int")
    with pytest.raises(Exception, match="label out of range"):
        R.score(bad, "logits", "y").collect()

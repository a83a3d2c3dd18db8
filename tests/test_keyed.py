import pytest
from pyspark.sql import functions as F

from hearth.operators import flags as Fl
from hearth.operators import keyed as K

PREFIXES = ["base_model.model.", "original_model."]


def params(spark, rows):
    return spark.createDataFrame(rows, "ord long, name string, value double, n long")


def test_key_collision_later_order_wins(spark):
    d = params(spark, [(0, "original_model.classifier.weight", 1.0, 10),
                       (1, "classifier.weight", 2.0, 10),
                       (2, "base_model.model.x", 3.0, 5)])
    d = K.normalise_keys(d, "name", PREFIXES)
    out = {r.key: r.value for r in K.last_write_wins(d, "key", ["value"], "ord").collect()}
    assert out == {"classifier.weight": 2.0, "x": 3.0}


def test_key_drift_and_overlay(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "key string, value double")
    upd = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("z", 9.0)], "key string, value double")
    drift = {(r.key, r.status) for r in K.key_drift(base, upd, "key").collect()}
    assert drift == {("c", "missing"), ("z", "unexpected")}
    ov = {r.key: (r.value, r.from_update) for r in K.overlay(base, upd, "key", ["value"]).collect()}
    assert ov == {"a": (10.0, True), "b": (20.0, True), "c": (3.0, False)}
    with pytest.raises(Exception):
        K.overlay(base, upd, "key", ["value"], strict=True).collect()
    assert K.overlay(base, base, "key", ["value"], strict=True).count() == 3


def test_substring_traps(spark):
    d = params(spark, [(0, "pre_classifier.weight", 0.0, 4), (1, "Classifier.bias", 0.0, 6),
                       (2, "layer.0.q_lin", 0.0, 10)])
    f = {r.name: r.flag for r in Fl.flag_any(d, "name", ["classifier"]).collect()}
    assert f == {"pre_classifier.weight": True, "Classifier.bias": False, "layer.0.q_lin": False}
    inv = {r.name: r.flag for r in Fl.flag_inverse(d, "name", ["classifier"]).collect()}
    assert inv["layer.0.q_lin"] and not inv["pre_classifier.weight"]


def test_additive_keeps_existing(spark):
    d = params(spark, [(0, "a", 0.0, 1), (1, "b", 0.0, 1)]).withColumn("flag", F.col("name") == "a")
    out = {r.name: r.flag for r in Fl.flag_additive(d, "name", ["b"]).collect()}
    assert out == {"a": True, "b": True}
    reset = {r.name: r.flag for r in Fl.flag_any(d, "name", ["b"]).collect()}
    assert reset == {"a": False, "b": True}


def test_zero_match_pattern_reported(spark):
    d = params(spark, [(0, "layer.fc_1", 0.0, 1)])
    rep = {r.pattern: r.n_matched for r in Fl.pattern_report(d, "name", ["fc_1", "fc_4"]).collect()}
    assert rep == {"fc_1": 1, "fc_4": 0}


def test_target_matching_full_name_or_dot_suffix(spark):
    d = params(spark, [(0, "layer.0.attention.q_lin", 0.0, 1), (1, "q_lin", 0.0, 1),
                       (2, "xq_lin", 0.0, 1)])
    f = {r.name: r.flag for r in Fl.flag_targets(d, "name", ["q_lin"]).collect()}
    assert f == {"layer.0.attention.q_lin": True, "q_lin": True, "xq_lin": False}
    # two names glued together by a missing comma match nothing, and are reported
    rep = {r.pattern: r.n_matched for r in
           Fl.pattern_report(d, "name", ["q_link_lin"], mode="target").collect()}
    assert rep == {"q_link_lin": 0}


def test_flagged_share(spark):
    d = Fl.flag_any(params(spark, [(0, "classifier.w", 0.0, 30), (1, "emb", 0.0, 70)]),
                    "name", ["classifier"])
    r = K.flagged_share(d, "flag", "n").collect()[0]
    assert (r.n_flagged, r.n_total) == (30, 100) and r.share == pytest.approx(0.3)


def test_list_flagged(spark):
    d = Fl.flag_any(params(spark, [(0, "a.classifier", 0.0, 1), (1, "b", 0.0, 1)]), "name",
                    ["classifier"])
    assert [r.ord for r in Fl.list_flagged(d, "ord").collect()] == [0]


def test_overlay_null_update_and_null_keys(spark):
    base = spark.createDataFrame([("a", 1.0), (None, 2.0)], "key string, value double")
    upd = spark.createDataFrame([("a", None), (None, 5.0)], "key string, value double")
    ov = {r.key: (r.value, r.from_update) for r in K.overlay(base, upd, "key", ["value"]).collect()}
    # an update to NULL still replaces; NULL keys follow SQL semantics (no match)
    assert ov == {"a": (None, True), None: (2.0, False)}
    drift = sorted(r.status for r in K.key_drift(base, upd, "key").collect())
    assert drift == ["missing", "unexpected"]

import os
import random

import pytest

from hearth.operators import keyed as K
from hearth.operators.snapshots import SnapshotChain

SCHEMA = "key string, url string, size int"


def snapshots(rng, stages=6, keys=60):
    base = {f"k{i}": (f"base{i}", i) for i in range(keys)}
    out = [base]
    for v in range(1, stages):
        out.append({f"k{rng.randrange(keys + 20)}": (rng.choice([None, f"v{v}"]), rng.choice([None, v])) for _ in range(12)})
    return out


def rows(d):
    return [(k, *v) for k, v in d.items()]


def overlays(spark, stages, upto):
    """The chain of overlays, one join a stage."""
    state = spark.createDataFrame(rows(stages[0]), SCHEMA)
    for d in stages[1:upto + 1]:
        state = K.overlay(state, spark.createDataFrame(rows(d), SCHEMA), "key", ["url", "size"]).drop("from_update")
    return sorted(map(tuple, state.collect()), key=str)


def held(df):
    return sorted((tuple(r)[:3] for r in df.collect()), key=str)


@pytest.fixture()
def chain(spark, tmp_path):
    stages = snapshots(random.Random(3))
    c = SnapshotChain(spark, str(tmp_path / "chain"), "key", ["url", "size"], buckets=32).start(spark.createDataFrame(rows(stages[0]), SCHEMA))
    for v, d in enumerate(stages[1:], 1):
        c.append(spark.createDataFrame(rows(d), SCHEMA), v)
    return c, stages


def test_any_version_equals_the_chain_of_overlays(spark, chain):
    c, stages = chain
    for v in (0, 1, 3, 5, 9):
        assert held(c.as_of(v)) == overlays(spark, stages, min(v, 5)), v
    changed = {r.key: r.changed for r in c.as_of(5).collect()}
    assert changed == {k: max([v for v, d in enumerate(stages) if k in d]) for k in stages[0]}
    assert c.as_of(5)._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def files(c, v):
    top = f"{c.path}/bases/base_version={v}"
    return {int(d.split("=")[1]) for d in os.listdir(top) if d.startswith("bucket=")}


def test_compaction_rewrites_touched_buckets_only(spark, chain):
    c, stages = chain
    want = {v: overlays(spark, stages, v) for v in (1, 2, 3, 5)}
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{c.path}/bases/base_version=0") for f in fs}
    touched = c.compact(2)
    assert 0 < len(touched) < 32 and files(c, 2) <= set(touched)
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{c.path}/bases/base_version=0") for f in fs}
    assert before == after
    for v, rows_ in want.items():  # versions before, at and after the new base
        assert held(c.as_of(v)) == rows_, v
    assert c.compact(2) == []  # nothing is left to fold
    c.compact(5)
    for v, rows_ in want.items():
        assert held(c.as_of(v)) == rows_, v


def test_rerun_of_a_version_replaces_it(spark, chain):
    c, stages = chain
    c.append(spark.createDataFrame(rows(stages[3]), SCHEMA), 3)
    assert held(c.as_of(5)) == overlays(spark, stages, 5)
    with pytest.raises(ValueError):
        c.append(spark.createDataFrame([], SCHEMA), 0)


def test_null_keys_and_empty_snapshots(spark, tmp_path):
    base = spark.createDataFrame([(None, "b", 1), ("a", "b", 2)], SCHEMA)
    c = SnapshotChain(spark, str(tmp_path / "c"), "key", ["url", "size"], buckets=4).start(base)
    c.append(spark.createDataFrame([(None, "x", 9), ("a", None, None), ("new", "y", 1)], SCHEMA), 1)
    c.append(spark.createDataFrame([], SCHEMA), 2)
    assert held(c.as_of(2)) == sorted([(None, "b", 1), ("a", None, None)], key=str)
    none = SnapshotChain(spark, str(tmp_path / "n"), "key", ["url", "size"]).start(spark.createDataFrame([], SCHEMA))
    none.append(base, 1)
    assert none.as_of(1).count() == 0 and none.compact(1) == []

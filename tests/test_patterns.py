import random

import pytest

from hearth.operators import flags as Fl


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abC.é ") for _ in range(rng.randint(0, 12)))
    rows = [(i, word()) for i in range(300)] + [(1000, None), (1001, ""), (1002, "aaa.bbb.ccc"), (1003, ".."), (1004, "a.")]
    return spark.createDataFrame(rows, "id int, name string").repartition(3).cache()


def patterns(n, rng=None):
    rng = rng or random.Random(2)
    return ["".join(rng.choice("abC.é ") for _ in range(rng.randint(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 10, 5000])
def test_flags_equal_the_chain_of_contains(spark, names, n):
    some = patterns(n)
    got = {r.id: r.flag for r in Fl.flag_any_many(names, "name", some).collect()}
    rows = {r.id: r.name for r in names.collect()}
    assert got == {i: v is not None and any(p in v for p in some) for i, v in rows.items()}
    if 0 < n <= 10:
        assert got == {r.id: r.flag for r in Fl.flag_any(names, "name", some).collect()}


@pytest.mark.parametrize("n", [10, 5000])
def test_report_counts_each_pattern(spark, names, n):
    some = sorted(set(patterns(n))) + ["", "never there"]
    rows = [r.name for r in names.collect() if r.name is not None]
    got = {r.pattern: r.n_matched for r in Fl.pattern_report_many(names, "name", some).collect()}
    assert got == {p: sum(p in v for v in rows) for p in some}
    if n == 10:
        assert got == {r.pattern: r.n_matched for r in Fl.pattern_report(names, "name", some).collect()}


def test_repeated_patterns_and_places(spark, names):
    df = names.where("id = 1002")
    assert df.select(Fl.contained("name", ["bbb", "x", "bbb", "", "a.b"])).head()[0] == [0, 2, 3, 4]
    with pytest.raises(ValueError):
        Fl.contained("name", ["x" * (Fl.PATTERNS_MAX_BYTES + 1)])


@pytest.mark.parametrize("as_table", [False, True])
def test_targets_equal_the_chain_of_tests(spark, names, as_table):
    some = sorted(set(patterns(400))) + ["", "bbb.ccc", "ccc", "cc", "aaa.bbb.ccc"]
    targets = spark.createDataFrame([(t,) for t in [*some, "ccc", None]], "target string") if as_table else some
    rows = {r.id: r.name for r in names.collect()}
    want = {(i, t) for i, v in rows.items() if v is not None for t in some if v == t or v.endswith("." + t)}
    got = [(r.id, r.target) for r in Fl.match_targets(names, "id", "name", targets).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = {r.pattern: r.n_matched for r in Fl.target_report_many(names, "id", "name", targets).collect() if r.pattern is not None}
    assert report == {t: sum(x == t for _, x in want) for t in some}
    few = some[-5:]
    flagged = {r.id for r in Fl.flag_targets(names, "name", few).collect() if r.flag}
    assert flagged == {i for i, t in want if t in few}


def test_plan_does_not_grow_with_the_patterns(names):
    plan = lambda n: len(Fl.flag_any_many(names, "name", patterns(n))._jdf.queryExecution().executedPlan().toString())
    assert plan(5000) < 2 * plan(5)

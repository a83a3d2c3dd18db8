import pytest
from pyspark.sql import functions as F

from hearth.operators import positional as P


def numbered(spark, n, parts=4, step=3):
    return spark.range(n).select((F.col("id") * step + 7).alias("k"), F.col("id").alias("v")) \
        .repartition(parts)


@pytest.mark.parametrize("route", [P.TOP_K_MAX_ROWS, 0])
def test_past_the_end_slice_clips(spark, route):
    assert P.slice_range(numbered(spark, 170), "k", 160, 200, top_k_max_rows=route).count() == 10
    assert P.slice_range(numbered(spark, 100), "k", 160, 200, top_k_max_rows=route).count() == 0


@pytest.mark.parametrize("route", [P.TOP_K_MAX_ROWS, 0])
def test_slice_rows_are_the_right_ones(spark, route):
    got = sorted(r.v for r in P.slice_range(numbered(spark, 500), "k", 123, 321,
                                            top_k_max_rows=route).collect())
    assert got == list(range(123, 321))


def test_short_last_batch(spark):
    sizes = {r.batch_id: r.n_rows for r in P.batch_summary(numbered(spark, 65), "k", 64).collect()}
    assert sizes == {0: 64, 1: 1}


def test_batch_sizes_sum_to_n(spark):
    rows = P.batch_summary(numbered(spark, 1000, parts=7), "k", 33).collect()
    assert sum(r.n_rows for r in rows) == 1000
    assert len(rows) == 31


@pytest.mark.parametrize("parts", [1, 8])
def test_positions_independent_of_partitioning(spark, parts):
    df = numbered(spark, 777, parts=parts)
    idx = P.PositionIndex.build(df, "k", num_buckets=13)
    got = {r.v: r.pos for r in idx.with_position(df).collect()}
    assert got == {i: i for i in range(777)}


def test_null_keys_sort_first(spark):
    df = spark.createDataFrame([(None, 0), (5, 1), (3, 2)], "k long, v int")
    idx = P.PositionIndex.build(df, "k", num_buckets=4)
    got = {r.v: r.pos for r in idx.with_position(df).collect()}
    assert got == {0: 0, 2: 1, 1: 2}


def test_row_at_and_first_batch(spark):
    df = numbered(spark, 50)
    assert P.row_at(df, "k", 7).collect()[0].v == 7
    assert P.row_at(df, "k", 50).count() == 0
    assert sorted(r.v for r in P.first_batch(df, "k", 8).collect()) == list(range(8))


def test_split_fraction_and_positional(spark):
    df = numbered(spark, 200)
    s = {r.v: r.split for r in P.split_fraction(df, "k", 0.8).collect()}
    assert [s[i] for i in range(200)] == ["train"] * 160 + ["test"] * 40
    sp = P.split_positional(df, "k", [("a", 0, 150), ("b", 150, 300)])
    assert sp.groupBy("split").count().orderBy("split").collect()[1]["count"] == 50


def test_deep_slice_prunes_buckets(spark):
    df = numbered(spark, 1000)
    idx = P.PositionIndex.build(df, "k", num_buckets=20)
    lo, hi = idx.buckets_for(500, 510)
    assert hi - lo <= 1
    assert sorted(r.v for r in idx.slice(df, 500, 510).collect()) == list(range(500, 510))


def hot_table(spark):
    # 400 of 1000 rows share key 5 (a hot key); the rest are unique
    return spark.range(1000).select(
        F.when(F.col("id") < 400, F.lit(5)).otherwise(F.col("id") * 2 + 100).alias("k"),
        F.col("id").alias("v")).repartition(5)


def test_hot_key_is_split_and_positions_exact(spark):
    df = hot_table(spark)
    idx = P.PositionIndex.build(df, "k", num_buckets=20)
    assert idx.hot and max(idx.hot.values()) > 1          # the hot key got sub-buckets
    hot_bucket = next(iter(idx.hot))
    pieces = [c for (b, s), c in idx.counts.items() if b == hot_bucket]
    assert sum(pieces) == 400 and max(pieces) < 400       # no piece holds it whole
    rows = idx.with_position(df).collect()
    pos = sorted((r.pos, r.k) for r in rows)
    assert [p for p, _ in pos] == list(range(1000))
    assert [k for _, k in pos] == sorted(r.k for r in rows)
    again = {r.v: r.pos for r in idx.with_position(df).collect()}
    assert again == {r.v: r.pos for r in rows}            # deterministic


@pytest.mark.parametrize("fraction", [0.2, 0.5, 0.9])
def test_split_exact_inside_hot_key(spark, fraction):
    df = hot_table(spark)
    first, rest = P.split_predicates(df, "k", fraction)
    n_first, n_rest = df.filter(first).count(), df.filter(rest).count()
    assert n_first == int(fraction * 1000) and n_first + n_rest == 1000


def test_deep_slice_through_hot_key(spark):
    df = hot_table(spark)
    got = P.slice_range(df, "k", 350, 450, top_k_max_rows=0).collect()
    assert len(got) == 100
    assert sum(1 for r in got if r.k == 5) == 50


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.75, 1.0])
def test_split_routes_agree(spark, fraction):
    df = hot_table(spark)
    a_first, _ = P.split_predicates(df, "k", fraction)                     # top-k route
    idx = P.PositionIndex.build(df, "k", num_buckets=20)
    b_first, b_rest = P.split_predicates(df, "k", fraction, index=idx)     # index route
    n = int(fraction * 1000)
    assert df.filter(a_first).count() == n == df.filter(b_first).count()
    assert df.filter(b_rest).count() == 1000 - n


def test_split_exact_with_moderate_duplicates(spark):
    # every key appears 3 times: fewer copies than a bucket holds, so not "hot"
    df = spark.range(600).select((F.col("id") % 200).alias("k"), F.col("id").alias("v"))
    idx = P.PositionIndex.build(df, "k", num_buckets=8)
    for frac in (0.1, 0.5, 0.91):
        first, rest = P.split_predicates(df, "k", frac, index=idx)
        assert df.filter(first).count() == int(frac * 600)
        assert df.filter(rest).count() == 600 - int(frac * 600)
    pos = {r.v: r.pos for r in idx.with_position(df).collect()}
    assert sorted(pos.values()) == list(range(600))


def test_slice_routes_agree_on_repeated_keys(spark):
    df = spark.range(300).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    a = sorted(r.v for r in P.slice_range(df, "k", 40, 130).collect())
    b = sorted(r.v for r in P.slice_range(df, "k", 40, 130, top_k_max_rows=0).collect())
    assert a == b and len(a) == 90


@pytest.mark.parametrize("cast", ["CAST(1152921504606846976 + id AS BIGINT)", "CAST(id AS DECIMAL(38,0)) + CAST('1e30' AS DECIMAL(38,0))",
                                  "concat('https://same.example/', lpad(id, 6, '0'))", "date_add(DATE'2000-01-01', CAST(id AS INT))",
                                  "timestamp_micros(id)", "CASE WHEN id < 700 THEN 9007199254740993 ELSE id END",
                                  "CASE WHEN id % 3 = 0 THEN NULL ELSE 9007199254740992 + id % 7 END"])
def test_index_route_orders_every_key_type(spark, cast):
    df = spark.range(2000).selectExpr("id", f"{cast} AS k").repartition(5)
    want = [r.id for r in P.slice_range(df, "k", 900, 960, top_k_max_rows=10 ** 9).collect()]
    got = [r.id for r in P.slice_range(df, "k", 900, 960, top_k_max_rows=0).collect()]
    assert sorted(got) == sorted(want)
    idx = P.PositionIndex.build(df, "k", num_buckets=16)
    rows = idx.with_position(df).collect()
    assert sorted(r.pos for r in rows) == list(range(2000))
    first = lambda r: (r.k is not None, r.k if r.k is not None else 0)
    rows.sort(key=lambda r: r.pos)
    assert all(first(a) <= first(b) for a, b in zip(rows, rows[1:]))


def keys_of(kind, n):
    if kind == "text":  # one long common start
        return F.format_string("https://example.org/a/very/long/start/%09d", F.col("id") * 7919 % n)
    if kind == "decimal":
        return ((F.col("id") * 7919 % n).cast("decimal(38,0)") + F.lit("1000000000000000000000000000000").cast("decimal(38,0)"))
    if kind == "fraction":
        return ((F.col("id") * 7919 % n).cast("decimal(30,10)") / F.lit(10 ** 8).cast("decimal(10,0)")).cast("decimal(30,10)")
    if kind == "binary":
        return F.format_string("samestart%09d", F.col("id") * 7919 % n).cast("binary")
    return F.lit(2 ** 60) + F.col("id") * 7919 % n


@pytest.mark.parametrize("kind", ["text", "decimal", "fraction", "binary", "wide"])
def test_native_split_points_spread_the_keys(spark, kind):
    n = 4001
    df = spark.range(n).select(keys_of(kind, n).alias("k"), (F.col("id") * 7919 % n).alias("v")).repartition(5)
    idx = P.PositionIndex.build(df, "k", num_buckets=16)
    assert idx.native and idx.total == n
    sizes = [c for c in idx.counts.values() if c]
    assert len(sizes) >= 8 and max(sizes) <= n // 4  # over at least half the buckets, none of them large
    got = {r.v: r.pos for r in idx.with_position(df).collect()}
    assert got == {i: i for i in range(n)}
    assert sorted(r.v for r in idx.slice(df, 1999, 2013).collect()) == list(range(1999, 2013))
    assert P.PositionIndex.build(df, "k").native  # as the queries build it


def test_native_split_points_with_hot_null_and_few_keys(spark):
    import decimal
    rows = [("hot", i) for i in range(600)] + [(f"k{i:04d}", 1000 + i) for i in range(600)] + [(None, 5000 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(3)
    idx = P.PositionIndex.build(df, "k", num_buckets=16)
    assert idx.hot and max(idx.counts.values()) < 300  # the hot key is cut by hash
    pos = sorted((r.pos, r.k) for r in idx.with_position(df).collect())
    assert [p for p, _ in pos] == list(range(len(rows)))
    assert [k for _, k in pos] == [None] * 9 + ["hot"] * 600 + sorted(k for k, _ in rows if k and k != "hot")
    top = decimal.Decimal("9" * 5)
    few = spark.createDataFrame([(top,), (top,), (decimal.Decimal(1),)], "k decimal(5,0)")
    assert sorted(r.pos for r in P.PositionIndex.build(few, "k").with_position(few).collect()) == [0, 1, 2]
    none = few.limit(0)
    assert P.PositionIndex.build(none, "k").with_position(none).count() == 0


def test_small_integers_keep_the_double_search(spark):
    assert not P.PositionIndex.build(numbered(spark, 100), "k").native

import duckdb
import pytest
from pyspark.sql import functions as F

from hearth.operators.fileorder import FileOrder


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Several files of different sizes, one of them empty, whose rows are in no key's order."""
    path = f"{tmp_path_factory.mktemp('files')}/t"
    for k, n in enumerate((5, 1, 70, 0, 33, 200)):
        rows = spark.range(n).select(((F.col("id") * 37) % 211 + 1000 * k).alias("k"), F.lit(k).alias("file"), F.lit("x").alias("pos"))
        rows.coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def want(table):
    rows = duckdb.sql(f"SELECT k, file, filename, file_row_number AS r FROM read_parquet('{table}/*.parquet', filename=true, "
                      "file_row_number=true) ORDER BY encode(filename), r").fetchall()
    return [(k, f) for k, f, _, _ in rows]


def pairs(df):
    return [(r.k, r.file) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_equal_the_file_row_numbers(spark, table, want):
    order = FileOrder.build(spark, table)
    assert order.total == len(want) == 309 and len(order.files) == 5
    got = {r.at: (r.k, r.file) for r in order.with_position("at").collect()}
    assert [got[i] for i in range(309)] == want
    assert order.with_position("at").columns == ["k", "file", "pos", "at"]


@pytest.mark.parametrize("a,b", [(0, 5), (0, 309), (3, 9), (5, 6), (6, 76), (100, 100), (300, 999), (309, 400), (-4, 2), (75, 77)])
def test_slices(spark, table, want, a, b):
    assert sorted(pairs(FileOrder.build(spark, table).slice(a, b))) == sorted(want[max(a, 0):b])


def test_a_slice_reads_only_its_files(spark, table, want):
    order = FileOrder.build(spark, table)
    one = order.slice(10, 12)
    assert len(one.inputFiles()) <= len(order.files) + 1
    scanned = one.select(F.input_file_name().alias("f")).distinct().count()
    assert scanned == 1 and sorted(pairs(one)) == sorted(want[10:12])
    one.collect()
    node = one._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in node


def test_no_sort_window_or_shuffle_of_rows(spark, table):
    order = FileOrder.build(spark, table)
    for df in (order.with_position(), order.slice(3, 90), order.with_batch(32), order.split([("a", 0, 160), ("b", 160, 200)])):
        text = plan(df)
        assert "Sort" not in text and "Window" not in text
        assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text


def test_batches_and_splits(spark, table, want):
    order = FileOrder.build(spark, table)
    sizes = {r.batch_id: r["count"] for r in order.with_batch(64).groupBy("batch_id").count().collect()}
    assert sizes == {0: 64, 1: 64, 2: 64, 3: 64, 4: 53}
    parts = order.split([("test", 160, 200), ("train", 0, 160)])
    assert sorted(pairs(parts.where("split = 'train'"))) == sorted(want[:160])
    assert sorted(pairs(parts.where("split = 'test'"))) == sorted(want[160:200])
    assert order.row_at(75).collect()[0].k == want[75][0] and order.row_at(309).count() == 0
    with pytest.raises(ValueError):
        order.split([("a", 0, 10), ("b", 9, 20)])
    assert order.split([]).count() == 0


def test_empty_table(spark, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/none")
    order = FileOrder.build(spark, f"{tmp_path}/none")
    assert order.total == 0 and order.with_position().count() == 0 and order.slice(0, 5).count() == 0


def test_many_files_join_by_shuffle_alike(spark, table, want, monkeypatch):
    monkeypatch.setattr("hearth.operators.fileorder.BROADCAST_FILES_MAX_BYTES", 0)
    got = {r.at: (r.k, r.file) for r in FileOrder.build(spark, table).with_position("at").collect()}
    assert [got[i] for i in range(309)] == want

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearth.sources import (append_metrics, check_schema, from_pandas, load_head, materialise,
                            read_pair, read_table, save_head, write_table)
from hearth.sources.schemas import SENTENCES

SF = "/root/testdata/sf0.001"


def test_read_table_checks_schema(spark):
    df = read_table(spark, f"{SF}/embeddings.parquet", "embeddings")
    assert df.columns == ["vec_id", "embedding", "label"]
    with pytest.raises(ValueError):
        read_table(spark, f"{SF}/embeddings.parquet", "documents")


def test_check_schema_reports_type(spark):
    df = spark.createDataFrame([("a", "x", 1)], "sentence string, label string, idx long")
    with pytest.raises(ValueError, match="label"):
        check_schema(df.schema, SENTENCES)


def test_pair_and_sink_roundtrip(spark, tmpdir_path):
    pdf = pd.DataFrame({"sentence": ["good", "bad"], "label": [1, 0], "idx": [0, 1]})
    df = from_pandas(spark, pdf.astype({"label": "int32"}), "sentences")
    a, b = os.path.join(tmpdir_path, "train"), os.path.join(tmpdir_path, "validation")
    write_table(df, a)
    write_table(df.limit(1), b)
    pair = read_pair(spark, a, b, "sentences")
    assert {r.split: r["count"] for r in pair.groupBy("split").count().collect()} == \
        {"train": 2, "validation": 1}


def test_head_save_load(spark, tmpdir_path):
    w, b = np.arange(6.0).reshape(2, 3), np.array([0.5, -0.5])
    path = os.path.join(tmpdir_path, "head")
    save_head(spark, path, w, b)
    w2, b2 = load_head(spark, path)
    assert np.array_equal(w, w2) and np.array_equal(b, b2)


def test_metrics_append_and_materialise(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "metrics")
    m = spark.createDataFrame([(0, 0.5)], "round int, accuracy double")
    append_metrics(m, path)
    append_metrics(m.withColumn("round", F.lit(1)), path)
    assert spark.read.parquet(path).count() == 2
    frozen = materialise(spark.range(10), "ten")
    assert frozen.count() == 10


def test_scale_conf_sizes():
    from hearth.session import scale_conf
    c = scale_conf(100 * 1024 ** 4, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) > 16000
    assert int(c["spark.sql.execution.arrow.maxRecordsPerBatch"]) * 768 * 8 <= 40 * 1024 ** 2
    small = scale_conf(10 * 1024 ** 2, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"


def test_a_retried_run_replaces_its_metrics(spark, tmp_path):
    path = str(tmp_path / "history")
    m = spark.createDataFrame([(0, 0.5)], "round int, accuracy double")
    for run in ("a", "b", "b", "c/d e"):
        append_metrics(m, path, run)
    assert sorted(r.run for r in spark.read.parquet(path).collect()) == ["a", "b", "c/d e"]

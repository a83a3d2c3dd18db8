"""Plan-shape regression tests: the physical properties the design relies on at
scale, read from ``explain()`` output."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hearth.operators import encode as E
from hearth.operators import positional as P
from hearth.operators import scoring as R

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_scans_read_only_needed_columns(spark):
    p = plan(entry.queries()["flag_any_substring"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p   # no text column
    p = plan(entry.queries()["key_drift"](spark, SF))
    assert "html" not in p.split("ReadSchema")[1].split("\n")[0]


def test_positions_never_use_a_single_partition_window(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars")
    idx = P.PositionIndex.build(df, "doc_id")
    p = plan(idx.with_position(df))
    assert "Window" in p and "SinglePartition" not in p
    assert "hashpartitioning(_hearth_bucket" in p


def test_deep_slice_and_split_push_key_ranges_into_the_scan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    p = plan(P.slice_range(df, "doc_id", 500, 520, top_k_max_rows=0))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id" in p
    first, rest = P.split_predicates(df, "doc_id", 0.8)
    assert "GreaterThanOrEqual(doc_id" in plan(df.filter(rest))


def test_lookup_encoder_is_map_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    vocab, nbytes = E.prepare_vocab(docs, "text", 100)
    tree = plan(E.encode(docs, "doc_id", "text", vocab, 32,
                         vocab_size_bytes=nbytes)).split("\n\n")[0]
    assert "ArrowEvalPython" in tree
    for op in ("Join", "Aggregate", "Exchange", "Generate"):
        assert op not in tree, op


def test_vocabulary_counts_are_partially_aggregated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = plan(E.build_vocab(docs, "text", 100))
    tree = p.split("\n\n")[0]
    below_exchange = tree[tree.index("Exchange"):]
    assert "HashAggregate" in below_exchange and "partial_count" in p
    assert "TakeOrderedAndProject" in tree


def test_overlay_reuses_key_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(entry.queries()["snapshot_overlay"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = p.split("\n\n")[0]
    assert tree.count("Exchange") == 2 and "SortMergeJoin" in tree


def test_stacked_heads_share_one_matmul(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    heads = [np.ones((10, 64)) * r for r in range(3)]
    tree = plan(R.stacked_logits(emb, "embedding", heads, keep=["vec_id"])).split("\n\n")[0]
    assert tree.count("ArrowEvalPython") == 1
    # no filter was inferred above the matmul
    assert "Filter" not in tree


def test_write_back_broadcasts_only_the_bounded_slice(spark):
    tree = plan(entry.queries()["score_writeback"](spark, SF)).split("\n\n")[0]
    assert "BroadcastHashJoin" in tree and "SortMergeJoin" not in tree

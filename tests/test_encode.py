import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.operators import encode as E


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(params=["lookup", "join", "split-join"])
def route(request):
    return request.param


def test_empty_and_blank_text_encode_to_specials(spark, route):
    d = docs(spark, ["", "   ", "a b"])
    vocab = E.build_vocab(d, "text", 10)
    enc = {r.doc_id: r for r in E.encode(d, "doc_id", "text", vocab, max_len=6,
                                         route=route).collect()}
    assert enc[0].input_ids == [E.BEGIN_ID, E.END_ID, 0, 0, 0, 0]
    assert enc[1].attention_mask == [1, 1, 0, 0, 0, 0]
    assert {r.doc_id for r in E.empty_inputs(d, "doc_id", "text").collect()} == {0, 1}
    with pytest.raises(Exception):
        E.empty_inputs(d, "doc_id", "text", strict=True).collect()


def test_over_long_text_truncated(spark, route):
    d = docs(spark, [" ".join(f"w{i}" for i in range(50))])
    vocab = E.build_vocab(d, "text", 100)
    r = E.encode(d, "doc_id", "text", vocab, max_len=8, route=route).collect()[0]
    assert len(r.input_ids) == 8 and r.attention_mask == [1] * 8
    assert r.input_ids[0] == E.BEGIN_ID and r.input_ids[-1] == E.END_ID
    rep = E.truncation_report(d, "doc_id", "text", 8).collect()[0]
    assert (rep.n_tokens, rep.n_kept, rep.truncated) == (50, 6, True)


def test_vocab_ties_and_unknown(spark, route):
    d = docs(spark, ["b a c", "a b", "d"])
    vocab = {r.token: r.id for r in E.build_vocab(d, "text", 2).collect()}
    assert vocab == {"a": 4, "b": 5}          # a, b tie on count: byte order
    r = {x.doc_id: x.input_ids for x in E.encode(d, "doc_id", "text",
                                                 E.build_vocab(d, "text", 2), 6,
                                                 route=route).collect()}
    assert r[0] == [2, 5, 4, E.UNK_ID, 3, 0]


def test_tokenisation_lowercases_and_splits_whitespace(spark):
    d = docs(spark, ["  Hello\tWORLD \n hello  "])
    assert E.token_counts(d, "doc_id", "text").collect()[0].n_tokens == 3
    assert {r.token: r.n for r in E.build_vocab(d, "text", 5).collect()} == {"hello": 2, "world": 1}


def test_mask_property(spark, route):
    texts = [" ".join(["x"] * n) for n in (0, 1, 5, 9, 30)]
    d = docs(spark, texts)
    for r in E.encode(d, "doc_id", "text", E.build_vocab(d, "text", 3), max_len=10,
                      route=route).collect():
        assert len(r.input_ids) == 10 and len(r.attention_mask) == 10
        assert sum(r.attention_mask) == min(r.n_tokens, 8) + 2


def test_map_batches_keeps_input_columns(spark):
    d = docs(spark, ["a b", "c"])
    out = E.map_batches(d, lambda pdf: {"n": pdf["text"].str.len()},
                        [T.StructField("n", T.LongType())])
    assert out.columns == ["doc_id", "text", "n"]
    assert sorted(r.n for r in out.collect()) == [1, 3]


def test_max_len_too_small(spark):
    with pytest.raises(ValueError):
        E.truncation_report(docs(spark, ["a"]), "doc_id", "text", 1)


@pytest.mark.parametrize("parts", [1, 8])
def test_encoding_independent_of_partitioning(spark, parts, route):
    texts = [" ".join(f"w{(i * 7 + j) % 13}" for j in range(i % 17)) for i in range(60)]
    d = docs(spark, texts).repartition(parts)
    enc = {r.doc_id: r.input_ids for r in
           E.encode(d, "doc_id", "text", E.build_vocab(d, "text", 8), max_len=12,
                    route=route).collect()}
    ref = docs(spark, texts).coalesce(1)
    want = {r.doc_id: r.input_ids for r in
            E.encode(ref, "doc_id", "text", E.build_vocab(ref, "text", 8), max_len=12,
                     route="join").collect()}
    assert enc == want


def test_duplicate_keys_encode_separately(spark, route):
    d = spark.createDataFrame([(1, "a b"), (1, "c")], "doc_id long, text string")
    rows = E.encode(d, "doc_id", "text", E.build_vocab(d, "text", 5), max_len=5,
                    route=route).collect()
    assert sorted(sum(r.attention_mask) for r in rows) == [3, 4]


def test_prepare_vocab_measures_bytes(spark):
    d = docs(spark, ["aa bb aa", "cc"])
    vocab, nbytes = E.prepare_vocab(d, "text", 10)
    assert vocab.count() == 3 and nbytes == 3 * (2 + 16)


def test_null_text_encodes_like_empty(spark, route):
    d = spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string")
    rows = {r.doc_id: r for r in E.encode(d, "doc_id", "text", E.build_vocab(d, "text", 5),
                                          max_len=4, route=route).collect()}
    assert rows[1].input_ids == [E.BEGIN_ID, E.END_ID, 0, 0]
    assert rows[2].input_ids == [E.BEGIN_ID, 4, E.END_ID, 0]


def test_non_consecutive_vocab_falls_back(spark):
    d = docs(spark, ["a b c"])
    vocab = spark.createDataFrame([("a", 10), ("c", 7)], "token string, id int")
    r = E.encode(d, "doc_id", "text", vocab, max_len=6, route="lookup").collect()[0]
    assert r.input_ids == [E.BEGIN_ID, 10, E.UNK_ID, 7, E.END_ID, 0]


def test_split_join_uses_head_and_tail(spark, monkeypatch):
    monkeypatch.setattr(E, "HEAD_VOCAB_ROWS", 2)    # head = 2 hottest tokens
    d = docs(spark, ["a a a b b c d", "c d e"])
    vocab = E.build_vocab(d, "text", 4)
    got = {r.doc_id: r.input_ids for r in
           E.encode(d, "doc_id", "text", vocab, 10, route="split-join").collect()}
    want = {r.doc_id: r.input_ids for r in
            E.encode(d, "doc_id", "text", vocab, 10, route="lookup").collect()}
    assert got == want


def test_null_text_has_no_tokens_on_every_route(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "k long, t string")
    vocab = E.build_vocab(df, "t", 10)
    want = [1, 1, 0, 0, 0]
    for route in ("lookup", "join", "split-join"):
        got = {r.k: r.attention_mask for r in E.encode(df, "k", "t", vocab, 5, route=route).collect()}
        assert got[2] == got[3] == want, route
    assert {r.k for r in E.empty_inputs(df, "k", "t").collect()} == {2, 3}


def test_map_batches_keeps_wide_integers_beside_nulls(spark):
    df = spark.createDataFrame([(9007199254740993,), (None,)], "k long")
    out = E.map_batches(df, lambda pdf: {"n": [1] * len(pdf)}, [T.StructField("n", T.IntegerType())])
    assert {r.k for r in out.collect()} == {9007199254740993, None}


def test_mask_without_vocabulary_equals_the_encoder(spark):
    df = spark.createDataFrame([(0, "a b c d e f"), (1, ""), (2, None), (3, "x")], "id long, text string")
    vocab, size = E.prepare_vocab(df, "text", 3)
    want = E.encode(df, "id", "text", vocab, 6, vocab_size_bytes=size).select("id", "n_tokens", "attention_mask")
    got = E.attention_mask(df, "id", "text", 6)
    assert sorted(got.collect()) == sorted(want.collect())

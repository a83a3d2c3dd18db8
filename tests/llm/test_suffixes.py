import hashlib
import random

import numpy as np
import pyarrow as pa

from hearth.llm import suffixes
from hearth.llm.queries import op3_suffixes

from .conftest import fixture


def brute(rows, n=50):
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        if k is not None:
            for i in range(len(b) - n + 1):
                w = b[i:i + n]
                first[w] = min(k, first.get(w, k))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if k is not None and first[b[i:i + n]] < k:
                gone[i:i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_query_against_brute_force(spark, awkward, tmp_path):
    got = [tuple(r) for r in op3_suffixes(spark, fixture(spark, tmp_path, "documents", awkward)).collect()]
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted(got, key=str) == sorted(want, key=str)


def test_periodic_overlapping_and_shared(spark, scratch, monkeypatch):
    rng = random.Random(9)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.randint(10, 90))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for k in range(150)]
    rows += [(500, "a" * 400), (501, "a" * 120), (502, "ab" * 100), (503, "xab" * 70), (504, "z" * 49), (505, "z" * 49)]
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BUCKET_ANCHORS", 500)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in suffixes.remove_repeats(df, scratch).select(
        "doc_id", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256").collect()]
    assert sorted(got) == sorted(brute(rows))


def test_rewrite_keeps_whole_characters(spark, awkward, nothing, scratch):
    out = suffixes.remove_repeats(awkward, scratch, rewrite=True)
    assert out.columns[:len(awkward.columns)] == awkward.columns
    rows = out.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        n = len((r.text or "").encode())
        assert r._n_bytes - r._n_removed <= n <= r._n_bytes
    assert suffixes.remove_repeats(nothing, suffixes.Scratch(spark, "t")).count() == 0
    assert suffixes.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]
    assert suffixes.whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)]


def test_suffix_order():
    rng = np.random.default_rng(1)
    for size, top in ((0, 3), (1, 3), (200, 3), (700, 255)):
        b = rng.integers(1, top, size).astype(np.uint8)
        s = b.tobytes()
        want = sorted(range(size), key=lambda i: s[i:i + 72] + bytes(72 - len(s[i:i + 72])))
        got = suffixes.suffix_order(b)
        pad = lambda i: s[i:i + 50].ljust(50, b"\0")
        assert [pad(i) for i in got] == [pad(i) for i in want] and sorted(got.tolist()) == list(range(size))


def test_anchors_are_the_same_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 100, 5000).astype(np.uint8)
    bounds = np.array([0, 0, 30, 700, 701, 2900, 5000])
    whole = suffixes.anchors(buf, bounds)
    monkeypatch.setattr(suffixes, "BLOCK", 256)
    parts = suffixes.anchors(buf, bounds)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_suffix_order_of_long_repeats():
    rng = np.random.default_rng(8)
    for trial in range(60):
        blocks = [rng.integers(0 if trial % 2 else 97, 99, int(rng.integers(1, 160))).astype(np.uint8) for _ in range(4)]
        b = np.concatenate([blocks[k] for k in rng.integers(0, 4, 25)] + [np.zeros(trial % 3 * 40, np.uint8)])
        s = b.tobytes() + bytes(80)
        got = suffixes.suffix_order(b)
        assert sorted(got.tolist()) == list(range(len(b)))
        keys = [s[i:i + 72] for i in got]
        assert keys == sorted(keys)


def test_crowded_anchors_do_not_share_a_bucket(spark, scratch, monkeypatch):
    rng = random.Random(12)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    header = "Share this page with your friends now"  # 37 bytes, amid the text of each document
    rows = [(k, f"{own(90)}{header}{own(90)}") for k in range(600)]
    rows += [(600 + k, f"{own(30)}{rng.choice(rows)[1][60:150]}{own(20)}") for k in range(200)]  # its windows again
    rows += [(900 + k, own(60) + " " * rng.randint(40, 90) + own(60)) for k in range(300)]
    rows += [(2000 + k, f"{own(40)}{'-' * 49}{k % 7}{own(40)}") for k in range(300)]  # all but one byte of a window
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 9000)

    most, sent = [], []
    pieces = spark.createDataFrame([(str(k).encode(), k, t.encode()) for k, t in rows], "name binary, low long, piece binary")
    packed = pieces.repartition(4).mapInArrow(suffixes._pack_pieces, "chunk long, body binary, size long").collect()
    chunks = [suffixes.Pieces(bytes(r.body)) for r in packed]
    lists = [np.unique(suffixes.codes(c.h, 1), return_counts=True) for c in chunks]
    counts = {"chunk": list(range(len(chunks))), "bucket": [0] * len(chunks),
              "codes": [c.astype("<u4").tobytes() for c, _ in lists], "counts": [n.astype("<u4").tobytes() for _, n in lists]}
    told = suffixes._crowded(200)(pa.table(counts)).to_pylist()
    assert told
    for k, c in enumerate(chunks):
        crowded = c.crowded([t for t in told if t["chunk"] == k], 1)
        most += c.h[~crowded].tolist()
        for w in c.by_window(crowded):
            assert [w.texts[x].tobytes() for x in w.which] == [c.data[i:i + 50] for i in w.at.tolist()]
            sent += w.h.tolist()
    assert np.unique(np.array(most, np.uint64), return_counts=True)[1].max() < 200
    assert np.unique(np.array(sent, np.uint64), return_counts=True)[1].max() <= len(chunks)  # a chunk sends a window once

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in suffixes.remove_repeats(df, scratch).select(
        "doc_id", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256").collect()]
    assert sorted(got) == sorted(brute(rows))


def test_equal_windows_have_equal_cores():
    rng = random.Random(5)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [own(n) for n in (50, 51, 63, 90, 400)] + ["ab" * 40, "z" * 70]
    texts = [f"{own(rng.randint(0, 60))}{p}{own(rng.randint(0, 60))}".encode() for p in passages * 4] + [b"", own(49).encode()]
    data, bounds = suffixes._joined(texts)
    core, first, past = suffixes.anchors(np.frombuffer(data, np.uint8), bounds)
    of = {i: h for h, a, e in zip(core.tolist(), first.tolist(), past.tolist()) for i in range(a, e)}
    inside = [i for a, e in zip(bounds, bounds[1:]) for i in range(a, e - 49)]
    assert sorted(of) == inside  # each window has one core
    by_text = {}
    assert all(by_text.setdefault(data[i:i + 50], of[i]) == of[i] for i in inside)


def test_a_short_phrase_makes_no_candidates():
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = [f"{own(80)}{phrase}{own(80)}".encode() for phrase in [own(34) for _ in range(40)] for _ in "12"]
    data, bounds = suffixes._joined(texts)
    core, first, _ = suffixes.anchors(np.frombuffer(data, np.uint8), bounds)
    codes = suffixes.codes(core, 3)
    told = suffixes.Entries(codes, np.searchsorted(bounds, first, side="right"), 3)
    assert (told.times == 1).all()  # 34 bytes hold many a whole gram, and no core of 37


def test_buckets_grow_before_there_are_more():
    assert [suffixes.spread(n, 10) for n in (0, 9, 10, 1500)] == [1, 1, 2, 151]
    assert suffixes.spread(100 * suffixes.MANY, 10) == suffixes.MANY
    big = suffixes.spread(10**9, 10)
    assert 10**9 / (10 * suffixes.MOST) <= big <= 10**9 / (10 * suffixes.MOST) + 2


def test_chunks_are_filled_from_many_batches(spark):
    pieces = spark.createDataFrame([(str(k).encode(), k, b"x" * 100) for k in range(1000)], "name binary, low long, piece binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        packed = pieces.coalesce(1).mapInArrow(suffixes._pack_pieces, "chunk long, body binary, size long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.size for r in packed] == [100_000]
    assert sorted(suffixes.from_body(bytes(packed[0].body)).column("low").to_pylist()) == list(range(1000))


def test_buckets_of_many_sorts(spark, scratch, monkeypatch):
    rng = random.Random(13)
    pool = ["".join(rng.choice("abcd efgh") for _ in range(rng.randint(40, 200))) for _ in range(60)]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for k in range(400)]
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 9000)
    monkeypatch.setattr(suffixes, "BUCKET_ANCHORS", 300)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(suffixes, "MANY", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in suffixes.remove_repeats(df, scratch).select(
        "doc_id", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256").collect()]
    assert sorted(got) == sorted(brute(rows))


def test_suffix_order_of_some_positions():
    rng = np.random.default_rng(3)
    for trial in range(40):
        block = rng.integers(0 if trial % 2 else 97, 99, int(rng.integers(1, 120))).astype(np.uint8)
        b = np.concatenate([np.tile(block, 4), rng.integers(97, 99, 60).astype(np.uint8), block])
        wanted = np.flatnonzero(rng.random(len(b)) < 0.4)
        got, s = suffixes.suffix_order(b, wanted), b.tobytes() + bytes(80)
        assert sorted(got.tolist()) == wanted.tolist()
        keys = [s[i:i + 72] for i in got]
        assert keys == sorted(keys)

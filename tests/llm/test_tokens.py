import random
import time

import pyarrow as pa

from hearth.llm import tokens
from hearth.llm.common import Scratch
from hearth.llm.queries import op5_token_counts
from pyspark.sql import functions as F

from .conftest import fixture

ODD = ["a", "B", "é", "É", "ß", "ÿ", "Ÿ", "İ", "K", "Σ", "σ", "J̌", "é", "́", " ", "\n", "\t", "\x1c", "\x85",
       "\xa0", "'", "s", "'ll", "'S", ".", ",", "...", ",,", "1", "23", "½", "<|endoftext|>", "<|ENDOFTEXT|>",
       "<|startoftext|>", "日本", "한", "🎉", "-", "_", "\x00", "×", "÷", "ﬁ", "ª"]


def test_encode_many_is_the_library():
    rng = random.Random(1)
    path = tokens.default_path()
    tok = tokens.tokenizer(path)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", None, "  ", "word. Word, WORD."]
    flat, bounds = tokens.encode_many(path, pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert flat[bounds[k]:bounds[k + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_query_against_library(spark, awkward, tmp_path):
    tok = tokens.tokenizer(tokens.default_path())
    want = []
    for r in awkward.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    got = [tuple(r) for r in op5_token_counts(spark, fixture(spark, tmp_path, "documents", awkward)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_resynchronisation_of_huge_texts(spark, scratch, nothing):
    rng = random.Random(4)
    tok = tokens.tokenizer(tokens.default_path())
    texts = [" ".join("".join(rng.choice("abcdeé'1.") for _ in range(rng.randint(1, 9))) for _ in range(900)),
             "x1" * 3000, "y" * 700 + " " + "z9," * 800, "<|endoftext|>" * 200 + " a " * 500, None, ""]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = df.where("length(text) > 0").select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("hash"), "text")
    got = {(r.key, r.hash): r.n_tokens for r in
           tokens.count_huge(docs, tokens.default_path(), scratch, chunk=500, overlap=40).collect()}
    for r in docs.collect():
        assert got[(r.key, r.hash)] == len(tok.encode(r.text, add_special_tokens=False).ids)
    out = tokens.token_counts(df, Scratch(spark, "t"), huge=1000)
    assert {(r.doc_id, r.n_tokens) for r in out.collect()} == {
        (k, len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in rows}
    assert tokens.token_counts(nothing, Scratch(spark, "t")).count() == 0


def test_another_tokenizer_gives_its_ids(spark, awkward):
    """Byte-level pieces keep their blanks: the cuts at blanks don't hold, so the library reads whole texts."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.words_stand_alone(tokens.default_path()) and not tokens.words_stand_alone(path)
    tok = tokens.tokenizer(path)
    texts = ["two  words", " A b\nC", None, "", "x" * 300, "Ärger 日本"]
    flat, bounds = tokens.encode_many(path, pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokens.token_counts(awkward, Scratch(spark, "t"), path=path, huge=100).collect())
    assert got == sorted((str(r.doc_id), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect())


def test_a_huge_text_is_cut_in_linear_time():
    cut = tokens._cut_chunks(tokens.CHUNK_CHARS, tokens.OVERLAP_CHARS)
    text = "some words and more " * 2_500_000  # 50 MB
    start = time.time()
    rows = n = 0
    for b in cut(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["h"]), pa.array([text])], names=["key", "hash", "text"])])):
        rows, n = rows + b.num_rows, b.column(3)[0].as_py()
        assert b.nbytes < 4 * tokens.BATCH_BYTES
    assert rows == n == -(-(len(text) - tokens.OVERLAP_CHARS) // tokens.CHUNK_CHARS) and time.time() - start < 10

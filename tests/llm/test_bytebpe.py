import base64
import hashlib
import random
import re

import pytest
import tiktoken

from hearth.llm import bytebpe
from hearth.llm.queries import op11_byte_bpe

from .conftest import fixture


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(b):
    return hashlib.sha256(b).hexdigest()


ODD = ["I'm  we'll\n\n x'sy 'S <|endoftext|>", " \t\n", "a 　b c  d", "\x1c!\x1d \x85x", "日本語のテキスト、です。١٢٣ ½²", "🎉🎉 é é",
       "no", "  two  spaces  ", "tab\tand\r\nline \n", "1234567 8.9", "​‍", "a" * 999, "a" * 3000, "ab cd " * 2000, "…—“quoted”"]


def test_query_against_the_library(spark, tmp_path, awkward, library):
    rng = random.Random(5)
    alphabet = "abcdefgh ABC '\n\t.,é日ü　\x1c1²🎉"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(200)]
    texts += ["".join(rng.choice("abcdeinorst") for _ in range(n)) for n in (1022, 1023, 1024, 2500)]  # one long word
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = awkward.unionByName(more, allowMissingColumns=True)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in op11_byte_bpe(spark, fixture(spark, tmp_path, "documents", df)).collect())
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert got == sorted(want)


def test_rows_and_samples_of_any_size(spark, library, monkeypatch):
    texts = [f"word{i % 7} common text number {i}" for i in range(60)] + [None, "", "x" * 2000, "x" * 2000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    for size, rows in ((100, 1), (100, 10**6), (1 << 20, 5)):
        monkeypatch.setattr(bytebpe, "BATCH_BYTES", size)
        monkeypatch.setattr(bytebpe, "SAMPLE_ROWS", rows)
        got = {r.doc_id: r.ids for r in bytebpe.encode(df).collect()}
        assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_other_ranks(spark, library):
    """A tiny vocabulary in which a pair made late has a lesser rank than those before it."""
    pieces = [bytes([i]) for i in range(256)] + [b"abc", b"bc", b"ab", b"xyzw", b"zw", b"xy", b"yz", b"aa", b"aaaa", b"aaa"]
    import tempfile
    rng = random.Random(1)
    with tempfile.NamedTemporaryFile("wb") as f:
        f.write(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(pieces)))
        f.flush()
        own = tiktoken.Encoding("tiny", pat_str=bytebpe.default_pattern(),
                                mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
        texts = ["".join(rng.choice("abcxyzw") for _ in range(rng.randint(1, 20))) for _ in range(300)] + ["a" * k for k in range(1, 40)]
        df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, body string")
        got = {r.name: r.ids for r in bytebpe.encode(df, f.name, text="body", key="name").collect()}
        assert got == {str(i): own.encode_ordinary(t) for i, t in enumerate(texts)}
        ranks = bytebpe.read_ranks(f.name)
        for t in texts:
            assert bytebpe.heap_merge(ranks, t.encode()) == own.encode_ordinary(t)


def test_decode(spark, library):
    rows = [(1, library.encode_ordinary("Ärger, 日本 x")), (2, []), (3, None), (4, [5, -1]), (5, [50256]), (6, [5, None])]
    df = spark.createDataFrame(rows, "k int, ids array<int>")
    got = {r.k: r.decoded for r in bytebpe.decode(df).collect()}
    assert bytes(got[1]).decode() == "Ärger, 日本 x" and bytes(got[2]) == b"" and [got[k] for k in (3, 4, 5, 6)] == [None] * 4


def test_empty_table(spark, nothing):
    out = bytebpe.digests(bytebpe.encode(nothing))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_common_words_are_not_cut_again(spark, monkeypatch):
    """Stretches that are common words skip the pattern, and give the same numbers."""
    import pyarrow as pa
    import regex
    ranks, calls = {bytes([i]): i for i in range(256)}, []

    class Counted:
        def __init__(self, pattern, _compile=regex.compile):
            self.of = _compile(pattern).findall

        def findall(self, text):
            calls.append(text)
            return self.of(text)

    monkeypatch.setattr(regex, "compile", Counted)
    numbers = type("Broadcast", (), {"value": {"word": 0, " word": 1}})
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["word word new word, word"])], names=["k", "t"])
    (row,) = bytebpe._cut(ranks, bytebpe.default_pattern(), pa.int64(), numbers)(iter([batch]))
    assert sorted(calls) == [" new", " word,"]
    words = ["".join(bytebpe._char(b) for b in w) for w in (b"word", b" word")] + row.column(3).flatten().to_pylist()
    text = "".join(words[i] for i in memoryview(row.column(2)[0].as_py()).cast("i"))
    assert len(words) == 4 and text == "".join(bytebpe._char(b) for b in b"word word new word, word")


def test_words_that_the_pattern_cuts_when_they_stand_alone(spark, library):
    """``ab`` is a word only before ``c``, however common it is."""
    import public_tokenizers as P
    pattern = r"ab(?=c)|[a-z]|\s+"
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = tiktoken.Encoding("cut", pat_str=pattern, special_tokens={},
                                mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    texts = ["abc abc", "ab", "abc\nab ab", "ab abc"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in bytebpe.encode(df, pattern=pattern).collect()} == {
        i: own.encode_ordinary(t) for i, t in enumerate(texts)}


def test_digests_of_any_ids(spark, library):
    """Bytes that are no text, no ids, and ids that are null or unknown."""
    one = library.encode_ordinary("日本 é")
    rows = [(1, one[:1]), (2, [255, 128, 0]), (3, []), (4, None), (5, [5, None, 6]), (6, [60000])]
    coded = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.doc_id: tuple(r)[1:] for r in bytebpe.digests(coded).collect()}
    for k, ids in rows[:3]:
        want = b"".join(library.decode_single_token_bytes(i) for i in ids)
        assert got[k] == (len(ids), sha(",".join(map(str, ids)).encode()), sha(want))
    assert got[4][1:] == (None, None) and got[5] == (3, sha(b"5,6"), None) and got[6] == (1, sha(b"60000"), None)


def test_stretches_of_texts(library):
    """Each text is its stretches, and none begins with a blank after white space."""
    import numpy as np
    import pyarrow as pa
    rng, blanks = random.Random(8), re.findall(f"[{bytebpe.BLANK}]", "".join(map(chr, range(0x3001))))
    texts = ODD + [None, "", " ", "a", " a", "a ", "a  b", "a\n b c", "\u3000 a", "a \u3000b c", " a  b c ", "one two"]
    texts += ["".join(rng.choice("ab \n\u3000") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for some in (pa.array(texts), pa.array(["x y", None, *texts]).slice(2), pa.array([""]), pa.array([], pa.string())):
        seen, codes, ends = bytebpe._stretches(some)
        assert len(ends) == len(some)
        for t, a, b in zip(some.to_pylist(), np.concatenate([[0], ends]), ends):
            cut = [seen[c] for c in codes[a:b]]
            assert "".join(cut) == (t or "")
            assert all(x[-1] not in blanks and y[0] in blanks for x, y in zip(cut, cut[1:]))
            assert sum((library.encode_ordinary(x) for x in cut), []) == library.encode_ordinary(t or "")

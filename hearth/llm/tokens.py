"""Encoding with a public tokenizer: exact, word-cached encoding in Arrow batches, and
overlap resynchronisation for huge documents.

The tokenizer drops white space and never merges across it, so the ids of a text are
those of its white-space-separated pieces one after the other. A batch is cut into
pieces by Arrow, each distinct piece is encoded once by the library, and the ids are
gathered with numpy. Pieces are cut at ASCII blanks only, which every rule of the
tokenizer treats as white space; all else is left to the library. A file with other
rules (:func:`words_stand_alone`) is left to the library text by text.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "word_bpe_49k.json"
HUGE_CHARS = 65_536  # longer texts are cut into overlapping chunks
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
BATCH_BYTES = 8 << 20
CACHE_PIECES = 100_000

_tokenizers: dict[str, object] = {}
_caches: dict[str, list[dict[str, bytes]]] = {}  # of each file: recent pieces, older pieces

def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker."""
    if path not in _tokenizers:
        import os

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


# Rules of the files whose words stand alone between blanks.
ALONE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


@functools.lru_cache(8)
def words_stand_alone(path: str) -> bool:
    """Whether the file's rules are those that the cuts at blanks and the encoding of lower-case
    words rely on: read from the file, since another one would give wrong ids in silence."""
    with open(path, "rb") as f:
        rules = json.load(f)
    model = rules["model"]
    return (all(rules.get(k) == v for k, v in ALONE.items()) and model["type"] == "BPE" and not model.get("dropout")
            and not any(c.isspace() for t in rules.get("added_tokens") or () for c in t["content"]))


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def _cached(path: str, pieces: list[str], encode) -> list[bytes]:
    """Ids of each piece as little-endian 32-bit numbers, new ones from ``encode``. Pieces used
    lately come from a cache of two generations: a full recent one becomes the older one."""
    young, old = _caches.setdefault(path, [{}, {}])
    out: list[bytes | None] = [young.get(p) for p in pieces]
    new = []
    for i, ids in enumerate(out):
        if ids is None:
            if (ids := old.get(pieces[i])) is None:
                new.append(i)
            else:
                out[i] = young[pieces[i]] = ids
    for k in range(0, len(new), 20_000):
        part = new[k:k + 20_000]
        for i, ids in zip(part, encode([pieces[i] for i in part])):
            out[i] = ids
            if len(young) < 2 * CACHE_PIECES:
                young[pieces[i]] = ids
    if len(young) > CACHE_PIECES:
        _caches[path] = [{}, young]
    return out


# A word of Latin letters that are composed and have simple lower case, and one mark.
_SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"


def _encode_words(tok):
    """Lower-case words of letters, each one unit of the tokenizer: encoded as one text."""

    def encode(words: list[str]) -> list[bytes]:
        e = tok.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(e.ids, "<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(words)))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    return encode


def _encode_any(tok):
    return lambda pieces: [np.array(e.ids, "<u4").tobytes()
                           for e in tok.encode_batch(pieces, add_special_tokens=False)]


def _distinct_ids(path: str, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pieces as one array, and how many each has.

    A simple word and the mark after it are units of their own: the word is encoded in
    lower case without the mark, so its forms are encoded once.
    """
    tok = tokenizer(path)
    marks = {m: tok.encode(m, add_special_tokens=False).ids for m in ".,"}
    simple = pc.match_substring_regex(pieces, _SIMPLE).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(simple)
    chosen = pieces.take(pa.array(at))
    size = np.zeros(len(pieces), np.int64)
    mark = np.zeros(len(pieces), np.int64)
    for m, ids in marks.items():
        mark[at[pc.ends_with(chosen, m).to_numpy(zero_copy_only=False)]] = ids[0]
        if len(ids) != 1:
            raise ValueError(f"the tokenizer cuts {m!r} into {len(ids)} tokens")
    words = pc.utf8_lower(pc.utf8_rtrim(chosen, ".,")).dictionary_encode()
    known = _cached(path, words.dictionary.to_pylist(), _encode_words(tok))
    other = np.flatnonzero(~simple)
    known += _cached(path + "*", pieces.take(pa.array(other)).to_pylist(), _encode_any(tok))
    source = np.empty(len(pieces), np.int64)
    source[at] = words.indices.to_numpy()
    source[other] = len(words.dictionary) + np.arange(len(other))
    n = np.fromiter(map(len, known), np.int64, len(known)) // 4
    flat = np.frombuffer(b"".join(known), "<u4")
    size = n[source] + (mark > 0)
    out = np.zeros(int(size.sum()), np.uint32)
    ends = np.cumsum(size)
    out[ends[mark > 0] - 1] = mark[mark > 0]
    fill = np.ones(len(out), bool)
    fill[ends[mark > 0] - 1] = False
    out[fill] = flat[_gather(np.concatenate([[0], np.cumsum(n)])[source], n[source])]
    return out, size


def _gather(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions ``start[k], start[k] + 1, ...`` (``n[k]`` of them) for each k in turn."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)


def encode_many(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many texts (null: empty), as one array and the texts' bounds in it."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    if not words_stand_alone(path):
        found = _encode_any(tokenizer(path))(filled.to_pylist())
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum([0, *(len(x) // 4 for x in found)])
    for blank in "\t\n\r":
        filled = pc.replace_substring(filled, blank, " ")
    lists = pc.split_pattern(filled, " ")  # empty pieces have no ids
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    flat, size = _distinct_ids(path, coded.dictionary)
    at = np.concatenate([[0], np.cumsum(size)])
    word = coded.indices.to_numpy()
    n = size[word]
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return flat[_gather(at[word], n)], np.concatenate([[0], np.cumsum(n)])[bounds]


def slices(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about ``limit`` bytes together: bounded memory
    however long the texts are."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def count_short(df: DataFrame, path: str) -> DataFrame:
    """``df (..., text)`` with n_tokens instead of the text."""
    names = [c for c in df.columns if c != "text"]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("n_tokens", T.LongType())])
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, at):
                _, bounds = encode_many(path, b.column(at))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(np.diff(bounds))],
                                                 names=[*names, "n_tokens"])

    return df.mapInArrow(run, schema)


CHUNK = "key long, hash string, k int, n int, first array<long>, first_at array<long>, last array<long>, last_at array<long>, n_tokens long"


def _encode_chunks(path: str):
    """For each chunk: tokens in all, and the stable boundaries (position in the document,
    tokens before it) in its first and last overlap. A boundary is stable where a token
    starts right after white space: what follows is encoded alike in every chunk that
    also has a token start there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text, start, overlap = r["chunk"], r["start"], r["overlap"]
                e = tok.encode(text, add_special_tokens=False)
                begins = np.array([o[0] for o in e.offsets], np.int64)
                stable = [i for i, c in enumerate(begins.tolist())
                          if c > 0 and text[c - 1] in " \t\n\r" and (i == 0 or begins[i - 1] < c)]
                stable = np.array(stable, np.int64)
                at = begins[stable] if len(stable) else np.zeros(0, np.int64)
                head, tail = at < overlap, at >= len(text) - overlap
                rows.append({"key": r["key"], "hash": r["hash"], "k": r["k"], "n": r["n"],
                             "first": (at[head] + start).tolist(), "first_at": stable[head].tolist(),
                             "last": (at[tail] + start).tolist(), "last_at": stable[tail].tolist(),
                             "n_tokens": len(e.ids)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("key", pa.int64()), ("hash", pa.string()), ("k", pa.int32()), ("n", pa.int32()),
                *((c, pa.list_(pa.int64())) for c in ("first", "first_at", "last", "last_at")),
                ("n_tokens", pa.int64())]))

    return run


CHUNKS = "key long, hash string, k int, n int, start long, overlap int, chunk string"


def _cut_chunks(chunk: int, overlap: int):
    """Rows ``CHUNKS`` of ``(key, hash, text)``: each text is cut once, in time linear in it."""

    def rows(key, hash_, text) -> Iterator[tuple]:
        n = max(-(-(len(text) - overlap) // chunk), 1)
        for k in range(n):
            yield key, hash_, k, n, k * chunk, overlap, text if n == 1 else text[k * chunk:(k + 1) * chunk + overlap]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
        for b in batches:
            for key, hash_, text in zip(*(c.to_pylist() for c in b.columns)):
                held: list[tuple] = []
                for row in rows(key, hash_, text):
                    held.append(row)
                    if len(held) * chunk >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    return run


def count_huge(docs: DataFrame, path: str, scratch, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``(key, hash, n_tokens)`` of huge texts ``docs (key, hash, text)``.

    Chunks overlap; neighbours are spliced at the first stable boundary that both have
    in their overlap. Documents with a pair of neighbours without one go round again
    with eight times the overlap, at last as one chunk.
    """
    done = None
    todo = docs.dropDuplicates(["key", "hash"])
    step = 0
    while True:
        pieces = todo.select("key", "hash", "text").mapInArrow(_cut_chunks(chunk, overlap), CHUNKS)
        made = scratch.save(pieces.repartition(F.col("key"), F.col("hash"), F.col("k"))
                            .mapInArrow(_encode_chunks(path), CHUNK), f"chunks{step}")
        a, b = made.alias("a"), made.alias("b")
        on = F.expr("a.key <=> b.key AND a.hash = b.hash AND a.k + 1 = b.k")
        cut = F.array_min(F.array_intersect("a.last", "b.first"))
        at = lambda side, pos, tok: F.element_at(f"{side}.{tok}", F.array_position(F.col(f"{side}.{pos}"), cut).cast("int"))
        # tokens of a from the cut on are b's; tokens of b before the cut are a's
        seams = a.join(b, on).select(
            "a.key", "a.hash", cut.isNull().alias("missing"),
            (F.col("a.n_tokens") - at("a", "last", "last_at") + at("b", "first", "first_at")).alias("twice"))
        sums = (made.select("key", "hash", "n_tokens", F.lit(0).alias("twice"), F.lit(False).alias("missing"))
                .unionByName(seams.select("key", "hash", F.lit(0).alias("n_tokens"), "twice", "missing"))
                .groupBy("key", "hash").agg((F.sum("n_tokens") - F.coalesce(F.sum("twice"), F.lit(0))).alias("n_tokens"),
                                            F.max("missing").alias("missing")))
        sums = scratch.save(sums, f"spliced{step}")
        good = sums.where("NOT missing").drop("missing")
        done = good if done is None else done.unionByName(good)
        if not sums.where("missing").head(1):
            return done
        step, overlap = step + 1, overlap * 8
        chunk = max(chunk, 2 * overlap)
        bad = sums.where("missing").select(F.col("key").alias("k2"), F.col("hash").alias("h2"))
        todo = scratch.save(todo.join(bad, F.col("key").eqNullSafe(F.col("k2")) & (F.col("hash") == F.col("h2")), "left_semi"),
                            f"again{step}")


def token_counts(df: DataFrame, scratch, path: str | None = None, text: str = "text", key: str = "doc_id",
                 limit: int = 2048, huge: int = HUGE_CHARS) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    A null text is empty: no bytes, no tokens. Special strings inside texts count as
    the library counts them by default. Repeated rows each give their row, an empty table
    none. Texts over ``huge`` characters are cut into chunks, if the file's words stand alone.
    """
    path = path or default_path()
    if not words_stand_alone(path):
        huge = 2 ** 31 - 1
    t = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).cast("long").alias("key"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text"))
    long_ = F.char_length("text") > huge
    short = count_short(docs.where(~long_), path)
    big = docs.where(long_).withColumn("hash", F.sha2("text", 256))
    counted = count_huge(big.select("key", "hash", "text"), path, scratch)
    c = counted.select(F.col("key").alias("k"), F.col("hash").alias("h"), "n_tokens")
    big = big.drop("text").join(c, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h"))).select(
        "key", "n_bytes", "n_tokens")
    return short.unionByName(big).select(F.col("key").alias(key), "n_bytes", "n_tokens",
                                         (F.col("n_tokens") > limit).alias("over_limit"))

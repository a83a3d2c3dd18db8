"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

An Arrow pass cuts whole texts by the vocabulary's pattern and emits, for each few
megabytes of text, the distinct words and the texts as numbers of words. Spark's
higher-order functions then fold the ranked merges over the byte array of each distinct
word: a step looks up every neighbouring pair in the rank map and joins the leftmost pair
of least rank. The rank map is a literal of the plan, an array of small maps chosen by the
hash of the pair. A last Arrow pass gathers the ids of each text. Nothing but a sample is
shuffled and every row is bounded by ``BATCH_BYTES`` of text or one text. Decoding joins the
bytes of the pieces.

Words that stand twice or more in a sample of ``SAMPLE_ROWS`` texts are folded first, once,
and broadcast, so that tasks fold only the rarer ones; what the sample holds changes the
work and not the result.

Inside the plan a byte array is a string of one character for each piece: the character
after ``FIRST`` with the piece's rank as its number.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hearth.llm.tokens import _gather, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BATCH_BYTES = 8 << 20  # text whose distinct words share a row
SAMPLE_ROWS = 20_000  # texts among which common words are sought
PLACES = 1024  # a word of so many bytes or more (no blank, mark or digit in it) is merged by a heap
BUCKETS = 1 << 15  # maps of the rank literal
FIRST = 0x100  # the character of rank 0
# White space as the patterns of public vocabularies take it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks; a few megabytes at most, as any vocabulary."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    missing = [i for i in range(256) if bytes([i]) not in ranks]
    if missing:
        raise ValueError(f"{path} lacks {len(missing)} of the 256 single bytes")
    return ranks


def _char(rank: int) -> str:
    """The character of a piece; surrogates are left out."""
    return chr(FIRST + rank if FIRST + rank < 0xD800 else FIRST + rank + 0x800)


def _literal(ranks: dict[bytes, int]) -> Column:
    """The rank map: for each hash a small map of a pair of pieces to ``PLACES`` times the
    rank of the piece they make."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                pair = _char(a) + _char(b)
                maps[xxhash.xxh64(pair.encode(), seed=42).intdigest() % BUCKETS][pair] = rank * PLACES
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"), ensure_ascii=False)), "array<map<string,bigint>>")


def _chars(ranks: dict[bytes, int]) -> Column:
    """The characters of all ranks, in their order."""
    return F.split(F.lit(" ".join(map(_char, range(max(ranks.values()) + 1)))), " ")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold(maps: Column, chars: Column, word: Column) -> Column:
    """The pieces of a word: ranked merges folded over its bytes; null for a very long word."""

    def ranked(pair: Column, i: Column) -> Column:
        """A pair's rank with its place, so that the leftmost pair of least rank is least."""
        return F.get(maps, F.xxhash64(pair).bitwiseAND(F.lit(BUCKETS - 1)))[pair] + i

    def merge(acc: Column, _: Column) -> Column:
        s, n = acc["pieces"], acc["n"]
        pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(2)))

        def joined(least: Column) -> Column:
            at = (least % PLACES + 1).cast("int")
            new = F.get(chars, F.shiftright(least, PLACES.bit_length() - 1))
            return F.when(least.isNotNull(), F.struct(
                F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + 2, n)).alias("pieces"),
                (n - 1).alias("n"))).otherwise(F.struct(s.alias("pieces"), F.lit(0).alias("n")))

        return F.when(n > 0, _let(F.array_min(F.transform(pairs, ranked)), joined)).otherwise(acc)

    n = F.char_length(word) - 1  # pairs that may merge; none once no pair does
    folded = F.aggregate(F.sequence(F.lit(0), n), F.struct(word.alias("pieces"), n.alias("n")), merge,
                         lambda acc: acc["pieces"])
    return F.when(F.char_length(word) < PLACES, folded)


def heap_merge(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The same merges for a very long word, with a heap of pairs."""
    parts: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue  # one of the two has been merged since
        parts[i], parts[j] = parts[i] + parts[j], None
        right[i] = right[j]
        if right[j] < len(parts):
            left[right[j]] = i
        for a in (left[i], i):
            if a >= 0 and right[a] < len(parts) and (r := ranks.get(both := parts[a] + parts[right[a]])) is not None:
                heapq.heappush(heap, (r, a, len(both)))
    return [ranks[p] for p in parts if p is not None]


class _Numbers(dict):
    """Numbers words in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _stretches(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct stretches of texts, the texts one after the other as numbers of stretches,
    and where each text ends among these.

    Arrow cuts at the blanks. A text with a blank after white space, where no stretch may
    begin, is cut by a regular expression; a stretch found in both ways stands twice.
    """
    parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
    bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    plain, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    blanks = {"", *re.findall(f"[{BLANK}]", "".join(map(chr, range(0x3001))))}
    wrong = np.fromiter((p[-1:] in blanks for p in plain), bool, len(plain))[place]
    wrong[bounds[1:] - 1] = False  # nothing follows a text's last part
    at = np.concatenate([[0], np.cumsum(wrong, dtype=np.int32)])
    odd = np.flatnonzero(at[bounds[1:]] > at[bounds[:-1]])
    place = 2 * place + np.int32(1)
    place[bounds[:-1]] -= 1  # a text's first part has no blank before it
    del parts, coded, wrong, at
    pa.default_memory_pool().release_unused()
    lengths, pieces = np.diff(bounds), []
    stretch = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+").findall
    more, low = _Numbers(), 0
    for t in odd.tolist():
        found = stretch(texts[t].as_py())
        pieces += [place[low:bounds[t]], np.int32(2 * len(plain)) + np.fromiter(map(more.__getitem__, found), np.int32, len(found))]
        low, lengths[t] = bounds[t + 1], len(found)
    place = np.concatenate([*pieces, place[low:]])
    used = np.flatnonzero(np.bincount(place, minlength=1))
    number = np.zeros(used[-1] + 1 if len(used) else 0, np.int32)
    number[used] = np.arange(len(used))
    late = list(more)
    seen = [late[u - 2 * len(plain)] if u >= 2 * len(plain) else " " * (u & 1) + plain[u >> 1] for u in used.tolist()]
    return seen, number[place], np.cumsum(lengths)


WORDS = "keys array<{key}>, ends binary, codes binary, words array<string>"


def _cut(ranks: dict[bytes, int], pattern: str, kind: pa.DataType, numbers):
    """Rows ``WORDS`` of texts: the distinct words of a few megabytes that are not common, as
    byte arrays, and each text as numbers of words, the common ones first.

    A word never runs from a visible character into white space, so texts are first cut into
    stretches there, and the pattern cuts each distinct stretch once.
    """
    single = {i: _char(ranks[bytes([i])]) for i in range(256)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        split = regex.compile(pattern).findall
        base = numbers.value if numbers else {}
        for batch in batches:
            for b in slices(batch, 1, BATCH_BYTES):
                known = _Numbers(base)
                seen, codes, ends = _stretches(b.column(1))
                n, flat = np.zeros(len(seen), np.int64), []
                for i, s in enumerate(seen):
                    words = (s,) if s in base else split(s) if s else ()  # a common word stands alone
                    n[i] = len(words)
                    flat += words
                flat = np.fromiter(map(known.__getitem__, flat), np.int32, len(flat))
                at = np.concatenate([[0], np.cumsum(n[codes])])
                out = flat[_gather((np.cumsum(n) - n)[codes], n[codes])]
                chars = [w.encode().decode("latin-1").translate(single) for w in islice(known, len(base), None)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b.column(0).to_pylist()], pa.list_(kind)),
                    pa.array([at[ends].astype("<i8").tobytes()], pa.binary()),
                    pa.array([out.astype("<i4").tobytes()], pa.binary()), pa.array([chars], pa.list_(pa.string()))],
                    names=["keys", "ends", "codes", "words"])

    return run


def _ids(ranks: dict[bytes, int]):
    """A function from the pieces of words (null: a very long word) and the words themselves to
    the ids of all words one after the other, and how many each has."""
    back = {ord(_char(ranks[bytes([i])])): i for i in range(256)}

    def ids(pieces: list[str | None], words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        for i in [i for i, p in enumerate(pieces) if p is None]:
            word = str(words[i]).translate(back).encode("latin-1")
            pieces[i] = "".join(map(_char, heap_merge(ranks, word)))
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4").astype(np.int32)
        return (chars - FIRST - 0x800 * (chars > 0xD7FF)).astype(np.int32), n

    return ids


def _gathered(ranks: dict[bytes, int], kind: pa.DataType, key: str, common):
    """Each text's ids, from the common words and the pieces of the row's words."""
    ids = _ids(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_ids, base_n = common.value
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                flat, n = ids(r.column(4).flatten().to_pylist(), r.column(3).flatten())
                flat, n = np.concatenate([base_ids, flat]), np.concatenate([base_n, n])
                code = np.frombuffer(r.column(2)[0].as_py(), "<i4")
                at = np.concatenate([[0], np.cumsum(n[code])])
                bounds = at[np.concatenate([[0], np.frombuffer(r.column(1)[0].as_py(), "<i8")])]
                out = flat[_gather((np.cumsum(n) - n)[code], n[code])]
                for part in _under(bounds):
                    low, high = bounds[part[0]], bounds[part[-1]]
                    yield pa.RecordBatch.from_arrays(
                        [r.column(0).flatten().slice(part[0], len(part) - 1).cast(kind),
                         pa.ListArray.from_arrays(pa.array(bounds[part] - low, pa.int32()), pa.array(out[low:high]))],
                        names=[key, "ids"])

    return run


def _folded(ranks: dict[bytes, int], words: DataFrame) -> DataFrame:
    """``words`` with the pieces of each word."""
    return words.select("*", _let(_literal(ranks), lambda maps: _let(
        _chars(ranks), lambda chars: F.transform("words", lambda w: _fold(maps, chars, w)))).alias("pieces"))


def common_words(texts: DataFrame, ranks: dict[bytes, int], pattern: str, rows: int | None = None):
    """Broadcasts of the words that stand twice or more in a sample of about ``rows`` of the
    ``texts (key, text)``, folded, as far as the pattern leaves them whole when they stand alone:
    their numbers, and their ids one after the other with how many each has. The sample bounds
    their number."""
    import regex
    rows = rows or SAMPLE_ROWS
    share = min(1.0, rows / max(1, texts.count()))
    sample = (texts.sample(share, seed=11) if share < 1 else texts).select(F.lit(0).cast("long"), texts.columns[1])
    cut = sample.mapInArrow(_cut(ranks, pattern, pa.int64(), None), WORDS.format(key="bigint"))
    # a word stands in a row's list once, so count the numbers that refer to it
    found = cut.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    lists = found.select("word", F.pmod(F.xxhash64("word"), F.lit(64)).alias("part")).groupBy("part").agg(
        F.collect_list("word").alias("words"))
    back = {_char(ranks[bytes([i])]): i for i in range(256)}
    table = str.maketrans({c: chr(i) for c, i in back.items()})
    words, pieces, plain = [], [], []
    split = regex.compile(pattern).findall
    for r in _folded(ranks, lists).select("words", "pieces").toLocalIterator():
        for w, p in zip(r["words"], r["pieces"]):
            word = w.translate(table).encode("latin-1").decode()
            if split(word) == [word]:  # the pattern leaves it whole where nothing follows, too
                words.append(w)
                pieces.append(p)
                plain.append(word)
    flat, n = _ids(ranks)(pieces, words)
    sc = texts.sparkSession.sparkContext
    return sc.broadcast(dict(zip(plain, range(len(plain))))), sc.broadcast((flat, n))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            n = np.bincount(np.frombuffer(b.column(2)[k].as_py(), "<i4"), minlength=len(b.column(3)[k].values))
            yield pa.RecordBatch.from_arrays([b.column(3)[k].values.cast(pa.string()), pa.array(n)], names=["word", "n"])


def _under(bounds: np.ndarray, limit: int = 1 << 22) -> Iterator[np.ndarray]:
    """Runs of neighbouring texts, as places in ``bounds``, that have about ``limit`` ids."""
    part = bounds[1:] // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        yield np.arange(a, b + 1)


def encode(df: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text",
           key: str = "doc_id") -> DataFrame:
    """``(key, ids)`` for every row: the ids of the whole text, as the library of the rank
    file gives them without special tokens.

    A null text is empty and has no ids; repeated rows and repeated or null keys each give
    their row; an empty table gives none. A text of any length is encoded whole. Other
    columns are left out, whatever their names.
    """
    ranks, pattern = read_ranks(path or default_path()), pattern or default_pattern()
    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)
    texts = df.select(F.col(key), F.col(text))
    numbers, common = common_words(texts, ranks, pattern)
    words = texts.mapInArrow(_cut(ranks, pattern, arrow, numbers), WORDS.format(key=kind.simpleString()))
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    return _folded(ranks, words).mapInArrow(_gathered(ranks, arrow, key, common), schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids, the pieces joined. Null ids give null, an id that
    the vocabulary doesn't have gives null bytes for the whole row, no ids give no bytes."""
    ranks = read_ranks(path or default_path())
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = base64.b64encode(piece).decode()
    # bytes as they are under a string's type, which is what strings are joined by
    known = F.from_json(F.lit(json.dumps(pieces)), "array<binary>").cast("array<string>")
    least, most = F.coalesce(F.array_min(ids), F.lit(0)), F.coalesce(F.array_max(ids), F.lit(0))
    fits = (F.size(_present(df, ids)) == F.size(ids)) & (least >= 0) & (most < len(pieces))
    joined = _let(known, lambda p: F.array_join(F.transform(ids, lambda i: F.get(p, i)), ""))
    return df.withColumn(to, F.when(fits, joined.cast("binary")))


def _present(df: DataFrame, ids: str) -> Column:
    """The ids that are not null; a pass over them only where the type allows nulls."""
    return F.array_compact(ids) if df.schema[ids].dataType.containsNull else F.col(ids)


def digests(coded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Key, number of ids, and digests of the ids and of the decoded bytes."""
    return decode(coded, path).select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.btrim(F.to_json(_present(coded, "ids")), F.lit("[]")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))

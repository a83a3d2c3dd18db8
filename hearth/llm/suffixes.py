"""Removal of repeated passages by suffix sorting (difference cover).

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a
smaller key goes. The work runs in four written steps:

1. *Anchors.* Of each ``LENGTH``-byte window the leftmost ``GRAM``-byte substring of least
   hash is its anchor, and the anchor with half of the window's other bytes, those on its
   longer side, is its core; equal windows have equal cores. Hashes of cores are dealt into
   buckets, and each bucket tells the chunks of documents which of theirs occur in two
   documents.
2. *Pieces.* Windows with such a core join into runs, cut at sparse cores into
   pieces. Equal pieces collapse into one with the smallest key before any sorting, so a
   passage of a third of all documents is sorted once.
3. *Suffix sorting.* Distinct pieces are packed into chunks, and the windows of a chunk are
   dealt by their anchor, as bodies of contexts, which puts equal windows into one bucket.
   The anchors of a bucket are sorted, some at a time, by the difference-cover algorithm:
   sampled triples (three 8-byte words at positions that are not multiples of three) are
   sorted and named, triples of names are sorted in the recursion, the remaining suffixes are
   sorted by first byte and rank of the next suffix, and both are merged. The recursion ends
   after one level as its names cover 72 bytes and strings are judged at 50. Adjacent
   prefixes are compared, each class of equal windows gets its smallest key, and each body
   is answered with one bit a window.
   An anchor whose contexts are half a sort or more (a short header amid each document's
   own text) would fill one task; chunks count contexts by anchor, learn by packed bits which
   are so crowded, and deal those anchors' windows by their own 50 bytes into buckets that
   are sorted in the same way. No table has a row for each occurrence of a window.
   Every chunk has a body for every bucket. Beyond ``MANY`` buckets these grow up to
   ``MOST`` times before there are more of them, so bodies stay large.
4. *Cutting.* Chunks turn the bits into intervals of their pieces, which return to the
   chunks of documents.

Steps 1 and 2 only drop windows that cannot repeat and copies of what is sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import Scratch
from hearth.llm.tokens import _gather, slices

LENGTH = 50
GRAM = 24
WINDOW = LENGTH - GRAM + 1
HALF = (LENGTH - GRAM) // 2
CHUNK_BYTES = 4 << 20
BLOCK = 1 << 18  # bytes hashed at a time
BUCKET_ANCHORS = 400_000
BUCKET_BYTES = 2 << 20
MANY = 200  # buckets, beyond which they grow before more are made
MOST = 16  # times
SPARSE = 12  # one core in so many cuts a run into pieces
MIN_PIECE = 32
_MUL = np.uint64(0x9E3779B97F4A7C15)


# ---- chunks: batches of rows as compressed Arrow, one row each ------------------------

def to_body(t: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(t)
    return sink.getvalue().to_pybytes()


def from_body(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def _make_chunks(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            for b in slices(batch, at, CHUNK_BYTES):
                whole = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in b.columns], schema=b.schema)
                size = sum(len(x) for x in texts_of(whole.column(at)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first], pa.int64()), pa.array([to_body(whole)], pa.binary()), pa.array([size], pa.int64())],
                    names=["chunk", "body", "size"])
                first += 1

    return run


def texts_of(column) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


class Chunk:
    """The texts of a chunk end to end, their bounds and keys; rows without a key are empty here."""

    def __init__(self, body: bytes, text: str, key: str):
        self.rows = from_body(body)
        self.keys = self.rows.column(key).to_pylist()
        self.texts = texts_of(self.rows.column(text))
        seen = [t if k is not None else b"" for t, k in zip(self.texts, self.keys)]
        self.data = b"".join(seen)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in seen])]).astype(np.int64)
        self.buf = np.frombuffer(self.data, np.uint8)


# ---- anchors --------------------------------------------------------------------------

def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position (GRAM = 16 + 8), by doubling."""
    with np.errstate(over="ignore"):
        h, p, n = b.astype(np.uint64) + np.uint64(1), _MUL, 1
        by8 = None
        while n < 16:
            h = h[:-n] * p + h[n:]
            p, n = p * p, 2 * n
            if n == 8:
                by8, p8 = h, p
        size = len(b) - GRAM + 1
        h = h[:size] * p8 + by8[16:16 + size]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of ``width`` (f: np.minimum or np.maximum)."""
    size, n = len(x) - width + 1, 1
    while 2 * n <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[:size], x[width - n:width - n + size])


def codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of each hash (the last bit of a gram's is always set)."""
    return (((h >> np.uint64(1)) % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32))


def windows(buf: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks: where one starts, the hashes of its grams, and the anchor of each of its windows
    (the leftmost least gram of the window alone), -1 for windows across a document's end."""
    low = np.uint64((1 << 20) - 1)
    for s in range(0, len(buf), BLOCK):
        e = min(len(buf), s + BLOCK + LENGTH - 1)
        if e - s < LENGTH:
            continue
        h = gram_hashes(buf[s:e])
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        a = (slide(packed, WINDOW, np.minimum) & low).astype(np.int32)
        for c in bounds[np.searchsorted(bounds, s):np.searchsorted(bounds, e)].tolist():
            a[max(0, c - s - LENGTH + 1):max(0, c - s)] = -1
        yield s, h, a


def stretches(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place of each run of equal ``kind`` that isn't negative."""
    edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]])
    ok = kind[edge[:-1]] >= 0
    return edge[:-1][ok], edge[1:][ok]


def anchors(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cores, and the runs [first, past) of windows that have them: the hash of the anchor
    with ``HALF`` bytes or one more of its longer side in the window. Equal windows have
    equal cores."""
    parts = []
    for s, h, a in windows(buf, bounds):
        left = a - np.arange(len(a), dtype=np.int32) > HALF
        first, past = stretches(np.where(a < 0, np.int32(-1), 2 * a + left))
        at, left = a[first], left[first]
        with np.errstate(over="ignore"):
            core = h[np.where(left, at - HALF - 1, at)] * _MUL + h[np.where(left, at, at + HALF)]
            core = (core ^ (core >> np.uint64(29)) ^ left.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            core ^= core >> np.uint64(32)
        parts.append((core, first + s, past + s))
    if not parts:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2
    core, first, past = (np.concatenate(x) for x in zip(*parts))
    new = np.ones(len(core), bool)  # a block's end or a short period parts no run
    new[1:] = (core[1:] != core[:-1]) | (first[1:] != past[:-1])
    return core[new], first[new], past[np.append(new, True)[1:]]


class Entries:
    """The sorted codes of a chunk, each as often as it has documents in the chunk, twice at most."""

    def __init__(self, code: np.ndarray, doc: np.ndarray, buckets: int):
        self.order = np.argsort(code)
        code, doc = code[self.order], doc[self.order]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        first = np.flatnonzero(new)
        self.times = 1 + (np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)) if len(first) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(first, len(code)))
        self.codes = np.repeat(code[first], self.times)
        self.cut = np.searchsorted(self.codes, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))

    def sent(self) -> tuple[np.ndarray, list[bytes]]:
        """Buckets and the codes that go there."""
        some = np.flatnonzero(np.diff(self.cut))
        data, cut = self.codes.astype("<u4").tobytes(), (4 * self.cut).tolist()
        return some.astype(np.int32), [data[cut[k]:cut[k + 1]] for k in some.tolist()]

    def told(self, answers: list) -> np.ndarray:
        """Which of the codes that were given occur in two documents."""
        bits = np.zeros(len(self.codes), bool)
        for t in answers:
            a, b = self.cut[t["bucket"]], self.cut[t["bucket"] + 1]
            bits[a:b] = np.unpackbits(np.frombuffer(t["bits"], np.uint8), count=int(b - a))
        hit = np.zeros(len(self.order), bool)
        hit[self.order] = np.repeat(bits[np.cumsum(self.times) - self.times], self.size)
        return hit


def spread(total: int, each: int) -> int:
    """Buckets for ``total``, of which one holds ``each``, and up to ``MOST`` times that beyond
    ``MANY`` buckets: every chunk has a row for every bucket."""
    n = total // each + 1
    return max(min(n, MANY), -(-n // MOST))


def _send_anchors(text: str, key: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body").to_pylist()):
                c = Chunk(body, text, key)
                h, first, _ = anchors(c.buf, c.bounds)
                some, blobs = Entries(codes(h, buckets), np.searchsorted(c.bounds, first, side="right"), buckets).sent()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array([chunk] * len(some), pa.int64()), pa.array(blobs, pa.binary())],
                    names=["bucket", "chunk", "codes"])

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """Of each chunk's codes in a bucket, the bits that tell which occur twice."""
    lists = [np.frombuffer(x, "<u4") for x in t.column("codes").to_pylist()]
    whole = np.concatenate(lists)
    order = np.argsort(whole)
    same = np.diff(whole[order]) == 0
    hit = np.zeros(len(whole), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    ends = np.cumsum([len(x) for x in lists]).tolist()
    bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip([0, *ends], ends)]
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary())})


# ---- pieces ---------------------------------------------------------------------------

def together(first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [first, past) in their order, those that touch as one."""
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != past[:-1]
    return first[new], past[np.append(new, True)[1:]]


PIECES = "name binary, piece binary, key long, chunk long, doc int, start long"


def _make_pieces(text: str, key: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, body, told in zip(*(b.column(c).to_pylist() for c in ("chunk", "body", "told"))):
                c = Chunk(body, text, key)
                h, first, past = anchors(c.buf, c.bounds)
                hit = Entries(codes(h, buckets), np.searchsorted(c.bounds, first, side="right"), buckets).told(told)
                if not hit.any():
                    continue
                start, end = together(first[hit], past[hit])
                sparse = first[(h >> np.uint64(8)) % np.uint64(SPARSE) == 0]
                if len(sparse):
                    sparse = sparse[np.append(True, np.diff(sparse) >= MIN_PIECE)]
                inside = np.searchsorted(start, sparse, side="right") - 1
                ok = (inside >= 0) & (sparse > start[inside]) & (sparse < end[inside])
                first = np.sort(np.concatenate([start, sparse[ok]]))
                last = np.sort(np.concatenate([end, sparse[ok]]))
                doc = np.searchsorted(c.bounds, first, side="right") - 1
                data = c.data
                pieces = [data[i:j] for i, j in zip(first.tolist(), (last + LENGTH - 1).tolist())]
                names = [hashlib.blake2b(x, digest_size=16).digest() for x in pieces]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(pieces, pa.binary()),
                     pa.array([c.keys[d] for d in doc.tolist()], pa.int64()), pa.array([chunk] * len(pieces), pa.int64()),
                     pa.array(doc.astype(np.int32)), pa.array(first - c.bounds[doc])],
                    names=["name", "piece", "key", "chunk", "doc", "start"])

    return run


# ---- suffix sorting -------------------------------------------------------------------

CONTEXT = pa.schema([("h", pa.uint64()), ("low", pa.int64()), ("text", pa.binary())])


def contexts(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with the same anchor (the leftmost least gram of the
    window alone): hash of the anchor, piece, first and past-the-last window."""
    parts = []
    for s, h, a in windows(buf, bounds):
        first, past = stretches(a)
        parts.append((h[a[first]], np.searchsorted(bounds, first + s, side="right") - 1, first + s, past + s))
    if not parts:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    data = b"".join(texts)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _pack_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of distinct pieces ``(name, low, piece)``: few and full, whatever the batches hold."""
    chunk, held, size = TaskContext.get().partitionId() << 33, [], 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([to_body(pa.Table.from_batches(held).combine_chunks())], pa.binary()),
                                           pa.array([size], pa.int64())], names=["chunk", "body", "size"])

    for whole in batches:
        for b in slices(whole, 2, CHUNK_BYTES):
            more = pc.sum(pc.binary_length(b.column(2))).as_py() or 0
            if held and size + more > CHUNK_BYTES:
                yield packed()
                chunk, held, size = chunk + 1, [], 0
            held, size = [*held, b], size + more
    if held:
        yield packed()


class Pieces:
    """A chunk of distinct pieces and its contexts. Every pass over a chunk finds the same."""

    def __init__(self, body: bytes):
        rows = from_body(body)
        self.names, self.lows = rows.column("name"), rows.column("low").to_numpy()
        self.data, self.bounds = _joined(rows.column("piece").to_pylist())
        self.buf = np.frombuffer(self.data, np.uint8)
        self.h, self.piece, self.first, self.past = contexts(self.buf, self.bounds)

    def crowded(self, told: list | None, buckets: int) -> np.ndarray:
        """Which contexts have an anchor that the buckets called crowded."""
        if not told:
            return np.zeros(len(self.h), bool)
        code = codes(self.h, buckets)
        known, place = np.unique(code, return_inverse=True)
        cut = np.searchsorted(known, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        bits = np.zeros(len(known), bool)
        for t in told:
            k = t["bucket"]
            bits[cut[k]:cut[k + 1]] = np.unpackbits(np.frombuffer(t["bits"], np.uint8), count=int(cut[k + 1] - cut[k]))
        return bits[place]

    def by_anchor(self, crowded: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets and their contexts."""
        mine = np.flatnonzero(~crowded)
        bucket = ((self.h[mine] >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            yield k, mine[order[cut[k]:cut[k + 1]]]

    def by_window(self, crowded: np.ndarray) -> Iterator["Windows"]:
        """The windows of crowded anchors, some at a time."""
        mine = np.flatnonzero(crowded)
        at = _gather(self.first[mine], self.past[mine] - self.first[mine])
        for k in range(0, len(at), BLOCK):
            yield Windows(self, at[k:k + BLOCK])


class Windows:
    """Windows that start ``at`` some places, equal ones taken together with their smallest key."""

    def __init__(self, c: Pieces, at: np.ndarray):
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(c.buf, LENGTH)[at])
        self.at = at
        self.low = c.lows[np.searchsorted(c.bounds, at, side="right") - 1]
        self.texts, self.which = np.unique(rows.view(f"V{LENGTH}").ravel(), return_inverse=True)
        self.least = np.full(len(self.texts), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, self.low)
        rows = np.frombuffer(self.texts.tobytes(), np.uint8).reshape(-1, LENGTH)
        h = np.full(len(rows), LENGTH, np.uint64)
        with np.errstate(over="ignore"):
            for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):
                h = (h ^ np.ascontiguousarray(rows[:, off:off + 8]).view("<u8").ravel()) * _MUL
                h ^= h >> np.uint64(29)
        self.h = h

    def buckets(self, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        bucket = (self.h % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(parts + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            yield k, order[cut[k]:cut[k + 1]]


def _send_counts(buckets: int):
    """Of each chunk and bucket the anchors and how many contexts each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body").to_pylist()):
                code, n = np.unique(codes(Pieces(body).h, buckets), return_counts=True)
                cut = np.searchsorted(code, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([chunk] * len(some), pa.int64()),
                     pa.array([code[cut[k]:cut[k + 1]].astype("<u4").tobytes() for k in some], pa.binary()),
                     pa.array([n[cut[k]:cut[k + 1]].astype("<u4").tobytes() for k in some], pa.binary())],
                    names=["bucket", "chunk", "codes", "counts"])

    return run


def _crowded(enough: int):
    """Of each chunk's anchors in a bucket, the bits that tell which have ``enough`` contexts."""

    def run(t: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, "<u4") for x in t.column("codes").to_pylist()]
        value, place = np.unique(np.concatenate(lists), return_inverse=True)
        n = np.bincount(place, np.concatenate([np.frombuffer(x, "<u4") for x in t.column("counts").to_pylist()]), len(value))
        hit = np.split((n >= enough)[place], np.cumsum([len(x) for x in lists])[:-1])
        some = [k for k, x in enumerate(hit) if x.any()]
        return pa.table({"chunk": t.column("chunk").take(pa.array(some, pa.int64())),
                         "bucket": t.column("bucket").take(pa.array(some, pa.int64())),
                         "bits": pa.array([np.packbits(hit[k]).tobytes() for k in some], pa.binary())})

    return run


DEALT = "bucket int, chunk long, part int, body binary"


def _send_contexts(buckets: int, parts: int):
    """The contexts of each chunk, a body for each bucket: by anchor in ``part`` -1, windows of
    crowded anchors by their own bytes in the parts from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, body, told in zip(*(b.column(c).to_pylist() for c in ("chunk", "body", "told"))):
                c = Pieces(body)
                crowded, out = c.crowded(told, buckets), []
                for k, r in c.by_anchor(crowded, parts):
                    texts = [c.data[i:j] for i, j in zip(c.first[r].tolist(), (c.past[r] + LENGTH - 1).tolist())]
                    out.append((k, -1, (c.h[r], c.lows[c.piece[r]], texts)))
                for part, w in enumerate(c.by_window(crowded)):
                    out += [(k, part, (w.h[r], w.least[r], w.texts[r].tolist())) for k, r in w.buckets(parts)]
                bodies = [to_body(pa.RecordBatch.from_arrays([pa.array(h), pa.array(low), pa.array(x, pa.binary())], schema=CONTEXT))
                          for _, _, (h, low, x) in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()),
                     pa.array([p for _, p, _ in out], pa.int32()), pa.array(bodies, pa.binary())],
                    names=["bucket", "chunk", "part", "body"])

    return run


def words8(b: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number that sorts like them."""
    w = b.astype(np.uint64)
    for n in (1, 2, 4):
        w = (w[:-n] << np.uint64(8 * n)) | w[n:]
    return w


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of rows of keys in their order."""
    order = _order(*keys)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(_changes(*(k[order] for k in keys))) + 1
    return rank


def _order(*keys: np.ndarray) -> np.ndarray:
    """Places of rows of keys in their order. Three ranks of up to 21 bits sort as one number."""
    if len(keys) == 3 and len(keys[0]) and all(k.dtype == np.int64 and k.max() < 1 << 21 for k in keys):
        keys = ((keys[0] << 42) | (keys[1] << 21) | keys[2],)
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where some key differs from the one before it."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def suffix_order(b: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions of ``b`` (those ``wanted``, or all) sorted by the 72 bytes that start there
    (zeros follow the end).

    Every comparison looks at 72 bytes, neither more nor less: the names of triples of
    names cover them, and one or two bytes before a sampled suffix go with its rank by
    71 or 70 bytes. So all the orders that are merged agree. Of the sampled suffixes, those
    are sorted that a wanted one is or meets in the merge, and those triples are named
    that they are made of.
    """
    n = len(b)
    wanted = np.arange(n) if wanted is None else wanted
    w = words8(np.concatenate([b, np.zeros(136, np.uint8)]))
    met, made = np.zeros(n + 2, bool), np.zeros(n + 50, bool)
    for k in (0, 1, 2):
        met[wanted + k] = True
    met[::3] = False
    s = np.flatnonzero(met)
    for k in (0, 24, 48):
        made[s + k] = True
    # sort sampled triples
    sampled = np.flatnonzero(made)
    word = _ranks(w[:n + 66])
    name = np.zeros(n + 50, np.int64)
    name[sampled] = _ranks(word[sampled], word[sampled + 8], word[sampled + 16])
    # recurse on names
    s = s[_order(name[s], name[s + 24], name[s + 48])]
    first = _changes(name[s], name[s + 24], word[s + 48], word[s + 56])
    by71, by70 = np.zeros(n + 2, np.int64), np.zeros(n + 2, np.int64)
    for rank, last in ((by71, 63), (by70, 62)):
        rank[s] = np.cumsum(first | _changes(word[s + last])) + 1
    # merge the remaining suffixes
    b = np.concatenate([b, np.zeros(2, np.uint8)]).astype(np.int64)
    one = lambda i: (b[i] << 40) | by71[i + 1]
    two = lambda i: (b[i] << 48) | (b[i + 1] << 40) | by70[i + 2]
    met[:] = False
    met[wanted] = True
    s, rest = s[met[s]], wanted[wanted % 3 == 0]
    rest = rest[np.argsort(one(rest))]
    s1, s2 = s[s % 3 == 1], s[s % 3 == 2]
    out = np.empty(len(wanted), np.int64)
    out[np.arange(len(rest)) + np.searchsorted(one(s1), one(rest)) + np.searchsorted(two(s2), two(rest))] = rest
    before = np.empty(len(s), np.int64)
    before[s % 3 == 1] = np.searchsorted(one(rest), one(s1), side="right")
    before[s % 3 == 2] = np.searchsorted(two(rest), two(s2), side="right")
    out[np.arange(len(s)) + before] = s
    return out


def equal_prefixes(b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Class of each of the sorted positions: adjacent ones with equal LENGTH bytes share it."""
    w = words8(np.concatenate([b, np.zeros(64, np.uint8)]))
    new = np.zeros(len(order), bool)
    for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        x = w[order + off]
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


ANSWERS = "chunk long, bucket int, part int, bits binary"


def _sort_bucket(t: pa.Table) -> pa.Table:
    """For each body a bit a window: it also starts in a document with a smaller key. The
    anchors of a bucket are sorted some at a time."""
    parts = [from_body(x) for x in t.column("body").to_pylist()]
    ends = np.cumsum([len(x) for x in parts])
    whole = pa.concat_tables(parts).combine_chunks()
    h, low = whole.column("h").to_numpy(), whole.column("low").to_numpy()
    text = whole.column("text")
    windows = pc.binary_length(text).to_numpy().astype(np.int64) - LENGTH + 1
    place = np.append(0, np.cumsum(windows))
    flags = np.zeros(int(place[-1]), bool)
    rows = np.argsort(h)
    new = np.diff(h[rows], prepend=~h[rows[:1]]) != 0
    alone = new & np.append(new[1:], True)
    rows, new = rows[~alone], new[~alone]
    size = np.cumsum(windows[rows] + LENGTH - 1)
    first = np.flatnonzero(new)
    cut = first[np.diff(size[first] // BUCKET_BYTES, prepend=-1) > 0].tolist()
    for a, b in zip(cut, [*cut[1:], len(rows)]):
        some = rows[a:b]
        flags[_gather(place[some], windows[some])] = _sort_contexts(np.cumsum(new[a:b]) - 1, low[some], text.take(pa.array(some)), windows[some])
    bits = [flags[a:b] for a, b in zip(place[np.append(0, ends[:-1])].tolist(), place[ends].tolist())]
    some = [k for k, x in enumerate(bits) if x.any()]
    return pa.table({c: t.column(c).take(pa.array(some, pa.int64())) for c in ("chunk", "bucket", "part")} |
                    {"bits": pa.array([np.packbits(bits[k]).tobytes() for k in some], pa.binary())})


def _sort_contexts(group: np.ndarray, lows: np.ndarray, texts: pa.ChunkedArray, windows: np.ndarray) -> np.ndarray:
    """Of the windows of contexts, whose anchors ``group`` numbers, those that some context
    with a smaller key has too."""
    # equal contexts are sorted once, with their smallest key
    coded = texts.combine_chunks().dictionary_encode()
    which, strings = coded.indices.to_numpy(), coded.dictionary
    low, of = np.full(len(strings), np.iinfo(np.int64).max), np.empty(len(strings), np.int64)
    np.minimum.at(low, which, lows)
    of[which] = group
    kept = np.flatnonzero(np.bincount(of)[of] > 1)
    flags = np.repeat(lows > low[which], windows)
    if not len(kept):
        return flags
    strings = strings.take(pa.array(kept))
    size = pc.binary_length(strings).to_numpy().astype(np.int64)
    base = np.full(len(low), -1, np.int64)
    base[kept] = np.cumsum(size) - size
    b = np.frombuffer(b"".join(strings.to_pylist()), np.uint8)
    start = _gather(base[kept], size - LENGTH + 1)
    owner_low = np.repeat(low[kept], size - LENGTH + 1)
    order = suffix_order(b, start)
    cls = equal_prefixes(b, order)
    least = np.empty(len(b), np.int64)
    least[start] = owner_low
    first = np.minimum.reduceat(least[order], np.flatnonzero(np.diff(cls, prepend=-1)))
    least[order] = first[cls]
    some = np.flatnonzero((base[which] >= 0) & (lows == low[which]))
    n = windows[some]
    at = np.cumsum(windows) - windows
    flags[_gather(at[some], n)] = least[_gather(base[which[some]], n)] < np.repeat(lows[some], n)
    return flags


LOWS = "m binary, low long, n int, part array<struct<lo:int,hi:int>>"


def _cover_pieces(buckets: int, parts: int):
    """The distinct pieces of each chunk with the intervals of their covered windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body, told, answers in zip(*(b.column(c).to_pylist() for c in ("body", "told", "answers"))):
                c = Pieces(body)
                found = {(x["part"], x["bucket"]): np.frombuffer(x["bits"], np.uint8) for x in answers or ()}
                crowded, covered = c.crowded(told, buckets), np.zeros(len(c.buf) + 1, bool)
                for k, r in c.by_anchor(crowded, parts):
                    if (-1, k) in found:
                        at = _gather(c.first[r], c.past[r] - c.first[r])
                        covered[at] = np.unpackbits(found[-1, k], count=len(at)).astype(bool)
                for part, w in enumerate(c.by_window(crowded)):
                    hit = np.zeros(len(w.texts), bool)
                    for k, r in w.buckets(parts):
                        if (part, k) in found:
                            hit[r] = np.unpackbits(found[part, k], count=len(r)).astype(bool)
                    covered[w.at] = hit[w.which] | (w.low > w.least[w.which])
                edge = np.flatnonzero(np.diff(covered, prepend=False))
                lo, hi = edge[::2], edge[1::2]
                piece = np.searchsorted(c.bounds, lo, side="right") - 1
                ends = np.searchsorted(piece, np.arange(len(c.lows) + 1))
                spans = pa.StructArray.from_arrays([pa.array((lo - c.bounds[piece]).astype(np.int32)),
                                                    pa.array((hi - c.bounds[piece]).astype(np.int32))], names=["lo", "hi"])
                yield pa.RecordBatch.from_arrays(
                    [c.names.combine_chunks(), pa.array(c.lows), pa.array(np.diff(c.bounds).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=["m", "low", "n", "part"])

    return run


# ---- cutting --------------------------------------------------------------------------

def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans shrunk so that no character is cut in two."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def _cut_chunks(text: str, key: str, rewrite: bool, schema: T.StructType):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body, told in zip(b.column("body").to_pylist(), b.column("told").to_pylist()):
                c = Chunk(body, text, key)
                spans: list[list[tuple[int, int]]] = [[] for _ in c.texts]
                for s in sorted((s["doc"], s["lo"], s["hi"]) for s in told or ()):
                    mine, a, e = spans[s[0]], s[1], s[2] + LENGTH - 1
                    if mine and a <= mine[-1][1]:
                        mine[-1] = (mine[-1][0], max(e, mine[-1][1]))
                    else:
                        mine.append((a, e))
                left = [cut(t, s) for t, s in zip(c.texts, spans)]
                stats = {"n_bytes": [len(t) for t in c.texts], "n_removed": [len(t) - len(x) for t, x in zip(c.texts, left)],
                         "n_spans": [len(s) for s in spans]}
                columns = {f"_{k}": pa.array(v, pa.int64()) for k, v in stats.items()}
                columns["_kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())
                rows = {n: c.rows.column(n) for n in c.rows.column_names}
                if rewrite:
                    old = c.rows.column(text).to_pylist()
                    new = [o if not s else cut(t, whole_characters(t, s)).decode("utf-8", "surrogatepass")
                           for o, t, s in zip(old, c.texts, spans)]
                    rows[text] = pa.chunked_array([pa.array(new, rows[text].type)])
                t = pa.table({**rows, **columns})
                yield from t.select(names).combine_chunks().to_batches()

    return run


def remove_repeats(df: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", rewrite: bool = False) -> DataFrame:
    """Every row of ``df`` with ``_n_bytes``, ``_n_removed``, ``_n_spans``, ``_kept_sha256``.

    The digests are those of the remaining bytes. With ``rewrite`` the text is replaced
    by what remains, where spans shrink to whole characters. A null text is empty (and
    stays null); a null key takes no part; rows with one key do not cover each other;
    an empty table gives none.
    """
    df = df.withColumn(key, F.col(key).cast("long"))
    chunks = scratch.save(df.mapInArrow(_make_chunks(df.columns.index(text)), "chunk long, body binary, size long"),
                          "chunks", codec="uncompressed")
    total = chunks.agg(F.sum("size")).head()[0] or 0
    buckets = spread(total // (WINDOW // 3), BUCKET_ANCHORS)

    sent = chunks.select("chunk", "body").mapInArrow(_send_anchors(text, key, buckets), "bucket int, chunk long, codes binary")
    bits = sent.groupBy("bucket").applyInArrow(_repeated, "chunk long, bucket int, bits binary")
    bits = scratch.save(bits, "bits")
    told = bits.groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("bucket", "bits")).alias("told"))
    pieces = chunks.join(told, F.col("chunk") == F.col("c")).select("chunk", "body", "told")
    pieces = scratch.save(pieces.mapInArrow(_make_pieces(text, key, buckets), PIECES), "pieces")
    scratch.drop("bits")

    distinct = pieces.groupBy("name").agg(F.min("key").alias("low"), F.first("piece").alias("piece"))
    packed = scratch.save(distinct.mapInArrow(_pack_pieces, "chunk long, body binary, size long"), "packed", codec="uncompressed")
    size = packed.agg(F.sum("size")).head()[0] or 0
    counted = spread(size // (WINDOW // 2), BUCKET_ANCHORS)
    parts = spread(size * (LENGTH + WINDOW // 2) // (WINDOW // 2), BUCKET_BYTES)
    counts = packed.select("chunk", "body").mapInArrow(_send_counts(counted), "bucket int, chunk long, codes binary, counts binary")
    crowded = counts.groupBy("bucket").applyInArrow(_crowded(max(2, BUCKET_BYTES // 2 // LENGTH)), "chunk long, bucket int, bits binary")
    crowded = crowded.groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("bucket", "bits")).alias("told"))
    packed = scratch.save(packed.join(crowded, F.col("chunk") == F.col("c"), "left").select("chunk", "body", "told"),
                          "marked", codec="uncompressed")
    dealt = packed.mapInArrow(_send_contexts(counted, parts), DEALT)
    answers = scratch.save(dealt.groupBy("bucket").applyInArrow(_sort_bucket, ANSWERS), "answers")
    answers = answers.groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct("part", "bucket", "bits")).alias("answers"))
    lows = packed.join(answers, F.col("chunk") == F.col("c"), "left").select("body", "told", "answers")
    lows = scratch.save(lows.mapInArrow(_cover_pieces(counted, parts), LOWS), "lows")
    scratch.drop("packed", "marked", "answers")
    all_of = F.array(F.struct(F.lit(0).alias("lo"), (F.col("n") - LENGTH + 1).cast("int").alias("hi")))
    hits = pieces.select("name", "key", "chunk", "doc", "start").join(lows, F.col("name") == F.col("m")).select(
        "chunk", "doc", "start", F.explode(F.when(F.col("key") > F.col("low"), all_of).otherwise(F.col("part"))).alias("w"))
    told = hits.groupBy(F.col("chunk").alias("c")).agg(F.collect_list(F.struct(
        "doc", (F.col("start") + F.col("w.lo")).alias("lo"), (F.col("start") + F.col("w.hi")).alias("hi"))).alias("told"))
    told = scratch.save(told, "told")
    scratch.drop("pieces", "lows")
    more = [T.StructField(f"_{n}", T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([*df.schema.fields, *more, T.StructField("_kept_sha256", T.StringType())])
    back = chunks.join(told, F.col("chunk") == F.col("c"), "left").select("body", "told")
    return back.mapInArrow(_cut_chunks(text, key, rewrite, schema), schema)

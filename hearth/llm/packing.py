"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Pieces of one length are interchangeable, so the plan is made on the histogram of
lengths (one count for each length up to the capacity, however many documents there
are), and one step of the plan fills as many equal sequences as the counts allow.
Pieces then find their place by their rank within their length, which distributed
prefix sums give.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import Scratch, hashed_bucket
from hearth.llm.tokens import default_path, encode_many, slices

CAPACITY = 4096
END_ID = 1
SMALL_ROWS = 100_000  # (length, bucket) counts: fewer rows, of three numbers each, are broadcast


def pieces(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
           keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``: little-endian 32-bit ids).

    A document's ids end with ``END_ID``; only longer ones than ``capacity`` are cut.
    """
    src = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                flat, bounds = encode_many(path, b.column(1))
                doc = b.column(0)
                rows, piece, start, blobs = [], [], [], []
                for r in range(b.num_rows):
                    ids = np.append(flat[bounds[r]:bounds[r + 1]], END_ID).astype("<u4")
                    for p, at in enumerate(range(0, len(ids), capacity)):
                        rows.append(r)
                        piece.append(p)
                        start.append(at)
                        blobs.append(ids[at:at + capacity].tobytes())
                cols = [doc.take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in blobs], pa.int64()),
                        pa.array([zlib.crc32(x) for x in blobs], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array(blobs, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)


def plan(count: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Slots ``(length, first rank, copies in a bin, bins, first bin, offset)`` that place
    ``count[l]`` pieces of each length ``l``.

    Each step fills a bin greedily with the longest piece that fits the gap, then
    replaces the bin's smallest piece by the two unpacked ones that fit its expanded gap
    most tightly, if that leaves less room, and repeats the bin while counts allow.
    """
    left = count.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)
    lengths = np.arange(capacity + 1)
    slots, first = [], 0
    while left.any():
        have = left.copy()
        bin_: dict[int, int] = {}
        gap = capacity
        while gap and (fit := np.flatnonzero(have[:gap + 1])).size:
            n = int(fit[-1])
            copies = int(min(gap // n, have[n]))
            bin_[n] = bin_.get(n, 0) + copies
            have[n] -= copies
            gap -= copies * n
        if gap and sum(bin_.values()) > 1:
            smallest = min(bin_)
            room = gap + smallest
            longest = np.maximum.accumulate(np.where(have > 0, lengths, 0))  # unpacked, at most x long
            a = np.flatnonzero(have[:room + 1])
            b = longest[np.minimum(a, room - a)]
            same = (a == b) & (have[a] < 2)
            b = np.where(same, longest[np.maximum(b - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if total.size and total.max() > smallest:
                k = int(np.flatnonzero(total == total.max())[-1])
                bin_[smallest] -= 1
                for n in (int(a[k]), int(b[k])):
                    bin_[n] = bin_.get(n, 0) + 1
                bin_ = {n: c for n, c in bin_.items() if c}
        bins = min(int(left[n]) // c for n, c in bin_.items())
        offset = 0
        for n, c in sorted(bin_.items(), reverse=True):
            slots.append((n, used[n], c, bins, first, offset))
            used[n] += c * bins
            left[n] -= c * bins
            offset += c * n
        first += bins
    out = np.array(slots, np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def place(slots: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank within the length."""
    key = (slots[:, 0] << 48) + slots[:, 1]
    s = slots[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
    nth = rank - s[:, 1]
    return s[:, 4] + nth // s[:, 2], s[:, 5] + (nth % s[:, 2]) * length


def pack(df: DataFrame, scratch: Scratch, path: str | None = None, text: str = "text", key: str = "doc_id",
         capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of all rows with ``sequence_id`` and ``offset``; ``keep_ids`` adds their ids,
    from which ``ORDER BY sequence_id, offset`` gives the packed sequences.

    A null or empty text is the one id ``END_ID``. Repeated rows each give their pieces;
    an empty table gives none. Reruns agree but for the order of identical rows.
    """
    spark = df.sparkSession
    made = scratch.save(pieces(df, path or default_path(), text, key, capacity, keep_ids), "pieces")
    hist = made.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    count = np.zeros(capacity + 1, np.int64)
    for r in hist:
        count[r["length"]] = r["n"]
    slots = plan(count, capacity)

    sizes = spark.createDataFrame([(int(r["length"]), int(r["n"])) for r in hist], "l long, n long")
    h = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 32)) / F.lit(2.0 ** 32)
    rows = (made.join(F.broadcast(sizes), F.col("length") == F.col("l")).withColumn("h", h)
            .withColumn("bucket", hashed_bucket(F.col("h"), F.col("n"))).drop("l", "n"))
    sums = rows.groupBy(F.col("length").alias("l"), F.col("bucket").alias("b")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("l").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.save(sums.select("l", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    small = F.broadcast(offsets) if offsets.count() <= SMALL_ROWS else offsets
    rows = rows.join(small, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
    w = Window.partitionBy("length", "bucket").orderBy("h", "doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("rank", F.col("base") + F.row_number().over(w) - 1).select(*made.columns, "rank")
    shared = spark.sparkContext.broadcast(slots)  # bounded by the capacity, not by the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = place(shared.value, b.column("length").to_numpy(), b.column("rank").to_numpy())
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)],
                                             names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, T.StructType([*made.schema.fields, T.StructField("sequence_id", T.LongType()),
                                           T.StructField("offset", T.LongType())]))

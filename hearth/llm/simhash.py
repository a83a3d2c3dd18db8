"""SimHash near-duplicates: fingerprints, then tiled exact comparison.

Equal fingerprints collapse into one class before any comparison. Classes are dealt
into tiles by the population counts of the fingerprint's four 16-bit words. Two
fingerprints within ``radius`` bits have counts whose differences add up to ``radius``
at most, so tile pairs further apart are never made. Tiles of a frequent count vector
are cut further by a hash and compared part by part. A pair of tiles is compared with
numpy exclusive-or and bit counts, every pair of fingerprints in it, and passes on a
spanning forest of the links found.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.common import Scratch, components, star_edges

SHINGLE = 3
RADIUS = 2
SEED = 42
TILE = 2048  # fingerprints in a tile, about
PART = 1 << 16  # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text (unsigned); 0 where there is no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return _majority([b" ".join(words)], xxh64_intdigest, seed)
    return _majority(map(b" ".join, zip(*(words[k:] for k in range(shingle)))), xxh64_intdigest, seed)


def _majority(shingles, digest, seed: int) -> int:
    ones, n = np.zeros(64, np.int64), 0
    it = map(digest, shingles, itertools.repeat(seed))
    while part := list(itertools.islice(it, PART)):
        h = np.array(part, "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``key, text_hash, fp``: fingerprints as signed longs."""
    src = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("text_hash"),
                    F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["key", "text_hash", "fp"])

    return src.mapInArrow(run, "key long, text_hash long, fp long")


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                nodes = np.concatenate([x, y])

                def links(x=x, y=y):
                    step = max(1, (1 << 19) // len(y))
                    for k in range(0, len(x), step):
                        i, j = np.nonzero(np.bitwise_count(x[k:k + step, None] ^ y[None, :]) <= radius)
                        yield i + k, j + len(x)

                node, root = star_edges(len(nodes), links())
                left.append(nodes[node])
                right.append(nodes[root])
            if left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(v).view(np.int64)) for v in (left, right)], names=["a", "b"])

    return run


def links(classes: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``classes (fp)`` whose components are those
    of all pairs within ``radius`` bits."""
    words = [F.bit_count(F.shiftright(F.col("fp"), 16 * k).bitwiseAND(F.lit(65535))) for k in range(4)]
    named = classes.select("fp", *[w.cast("int").alias(f"p{k}") for k, w in enumerate(words)])
    ps = ["p0", "p1", "p2", "p3"]
    # at most 17^4 = 83,521 rows, whatever the documents
    sizes = scratch.save(named.groupBy(*ps).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")), "sizes")
    tiles = (named.join(F.broadcast(sizes), ps).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .groupBy(*ps, "part").agg(F.collect_list("fp").alias("fps")))
    tiles = scratch.save(tiles, "tiles")

    near = [d for d in itertools.product(range(-radius, radius + 1), repeat=4)
            if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]  # each pair of vectors once
    steps = F.explode(F.array(*[F.array(*map(F.lit, d)) for d in near])).alias("d")
    a = sizes.select(F.struct(*ps).alias("p"), F.col("parts").alias("np"), steps)
    a = a.select("p", "np", F.struct(*[(F.col(f"p.p{k}") + F.get("d", F.lit(k))).alias(f"p{k}") for k in range(4)]).alias("q"))
    b = sizes.select(F.struct(*ps).alias("q"), F.col("parts").alias("nq"))
    pairs = a.join(F.broadcast(b), "q").select(
        "p", "q", "nq", F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("i")).select(
        "p", "q", "i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j")).where("p <> q OR i <= j")
    tp, tq = (tiles.select(F.struct(*ps).alias(c), F.col("part").alias(n), F.col("fps").alias(v))
              for c, n, v in (("p", "i", "x"), ("q", "j", "y")))
    work = pairs.join(tp, ["p", "i"]).join(tq, ["q", "j"]).where("p <> q OR i <> j OR size(x) > 1")
    # round robin: tile pairs are of bounded but unequal work
    return work.select("x", "y").repartition(_parts(classes)).mapInArrow(_compare(radius), "a long, b long")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_duplicates(df: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """``key``, fingerprint (16 hex digits), component_id, and text_hash and component (which
    name the row's text and its component, also where keys are null or repeat) for every row.

    component_id is the smallest key reachable over links of at most ``radius`` bits.
    Null and empty texts have the fingerprint zero and link like any other; rows with a
    null key take part and name no component (null where there is nothing else);
    repeated rows share a component; texts of any length are read whole; an empty table gives no
    rows.
    """
    docs = scratch.save(fingerprints(df, text, key, shingle), "fingerprints")
    classes = scratch.save(docs.groupBy("fp").agg(F.min("key").alias("low")), "classes")
    found = scratch.save(links(classes, scratch, radius), "links")
    roots = components(found, scratch)
    named = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    named = scratch.save(named, "named")
    lows = named.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component_id"))
    ids = scratch.save(named.join(lows, named.root == lows.r).select(
        F.col("fp").alias("f"), "component_id", F.col("root").alias("component")), "ids")
    return docs.join(ids, docs.fp == ids.f).select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        "text_hash", "component")


def one_of_each(df: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` with one document of each component: the one of the smallest key
    (null last), of several with that key the one of the smallest text hash."""
    found = scratch.save(near_duplicates(df, scratch, text, key, **options).withColumnRenamed(key, "k"), "found")
    first = F.min(F.struct(F.col("k").isNull().alias("n"), "k", "text_hash")).alias("m")
    best = found.groupBy("component").agg(first).select(F.col("m.k").alias("_best_key"), F.col("m.text_hash").alias("_best_hash"))
    best = scratch.save(best, "best")
    on = F.col(key).cast("long").eqNullSafe(F.col("_best_key")) & (F.xxhash64(F.col(text)) == F.col("_best_hash"))
    kept = df.join(best, on, "left_semi")
    again = found.groupBy("k", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    again = again.join(best, F.col("k").eqNullSafe(F.col("_best_key")) & (F.col("text_hash") == F.col("_best_hash")))
    if not again.head(1):
        return kept
    # rows that repeat key and text: as rare as broken keys, so only then is there a shuffle for them
    return (kept.withColumn("_best_text", F.xxhash64(F.col(text))).dropDuplicates([key, "_best_text"]).drop("_best_text"))

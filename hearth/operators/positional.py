"""Positional operators over an explicit order key.

Spark rows have no position, so every operator here takes the order key that
defines it. The total order is ``(key, xxhash64(row))``: the key, then a content
hash that orders repeated keys deterministically (identical rows are
interchangeable). Two physical routes give identical results:

* shallow slices use ``orderBy().offset().limit()``, planned as a per-task top-k
  and one merge of ``stop x input partitions`` rows, only while that product is
  within ``TOP_K_MAX_MERGE_ROWS``;
* deep slices and per-row positions use a :class:`PositionIndex`: quantile split
  points of the key define monotone buckets, one aggregation counts rows per
  bucket, and ``row_number`` runs *per bucket* (a hash exchange on the bucket id,
  never a single-partition window). Bucket offsets are a literal array whose
  size is the bucket count, not the data. A slice touches only the buckets that
  overlap it; for numeric keys their key range is also pushed into the scan.

A key holding a large share of the rows (e.g. a third) is isolated in its own
bucket and cut into hash ranges, so no window task holds it whole. The position
route is deterministic (no ``monotonically_increasing_id``), so a lost executor
recomputes exactly the same rows from lineage.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The top-k route merges (slice end) x (input partitions) rows in one task; it is
# used only while that product stays within this many rows, else the index route.
TOP_K_MAX_MERGE_ROWS = 200_000
# Kept for callers that pass it explicitly: 0 forces the index route.
TOP_K_MAX_ROWS = TOP_K_MAX_MERGE_ROWS
# Index sizing: rows per bucket (one window task each), bucket cap (the offsets
# literal), and sampled keys per bucket for the boundary sketch.
ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 16_384
SAMPLES_PER_BUCKET = 200
SPLIT_SAMPLES = 16  # sampled keys per bucket where split points are keys (at most 262,144 on the driver)
SPLIT_CHARS = 64

_BUCKET = "_hearth_bucket"
_SUB = "_hearth_sub"
_TIE = "_hearth_tie"
_KEYD = "_hearth_keyd"
_TWO63 = float(2 ** 63)


def _int_array(values: list[int]) -> Column:
    """A literal ``ARRAY<BIGINT>`` built by one parsed expression instead of one
    JVM call per element (the index can hold tens of thousands of entries)."""
    return F.expr("array(" + ",".join(f"CAST({int(v)} AS BIGINT)" for v in values) + ")")


def _numeric(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, T.NumericType)


def _projection(df: DataFrame, key: str) -> Column:
    """A DOUBLE that never falls as the key rises, for any orderable scalar type. It only
    chooses buckets: keys that share a value share a bucket, where the key itself orders."""
    kind, c = df.schema[key].dataType, F.col(key)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        start = F.substring(c.cast("binary"), 1, 6)  # strings sort by their UTF-8 bytes
        return F.conv(F.rpad(F.hex(start), 12, "0"), 16, 10).cast("double")
    raise TypeError(f"no order projection for key {key!r} of type {kind.simpleString()}")


def _native(df: DataFrame, key: str, least=None, most=None) -> bool:
    """Whether split points are keys of their own type: where a DOUBLE would not tell keys
    apart (texts, bytes, decimals, integers beyond 53 bits)."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.LongType):
        return least is not None and (least <= -2 ** 53 or most >= 2 ** 53)
    return isinstance(kind, (T.StringType, T.BinaryType, T.DecimalType))


def _after(value, kind: T.DataType):
    """The least key above ``value``."""
    if isinstance(kind, T.StringType):
        return value + "\0"
    if isinstance(kind, T.BinaryType):
        return bytes(value) + b"\0"
    if isinstance(kind, T.DecimalType):
        more = value.scaleb(kind.scale) + 1  # exact: a decimal of this type has at most 38 digits
        return None if len(more.as_tuple().digits) > kind.precision else more.scaleb(-kind.scale)
    return value + 1 if value < 2 ** 63 - 1 else None


def _native_splits(keys: DataFrame, key: str, num_buckets: int) -> list:
    """Split points in the key's own order, from sampled keys: each ``SPLIT_SAMPLES``-th of them,
    long texts by their first ``SPLIT_CHARS``. A key that fills a bucket or more gets one of its own."""
    kind, c = keys.schema[key].dataType, F.col(key)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        c = F.substring(c, 1, SPLIT_CHARS)
    rows = keys.where(F.col(key).isNotNull()).select(c.alias("k")).orderBy("k").collect()
    found = [r["k"] for r in rows]
    step = max(1, len(found) // num_buckets)
    points = found[step::step][:num_buckets - 1]
    out = []
    for i, v in enumerate(points):
        if not out or out[-1] != v:
            out.append(v)
        if i + 1 < len(points) and points[i + 1] == v and (i + 2 == len(points) or points[i + 2] != v):
            nxt = _after(v, kind)  # v fills a bucket: what follows starts another
            out += [nxt] if nxt is not None else []
    return out


def _search(key: Column, splits: list, kind: T.DataType) -> Column:
    """How many of the rising ``splits`` are not above the key: a binary search in the JVM, a few
    comparisons in the key's own type."""
    n = len(splits)
    if not n:
        return F.lit(0)
    points = F.array(*[F.lit(bytearray(v) if isinstance(v, bytes) else v).cast(kind) for v in splits])
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)])

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= n) & (F.get(points, at + by - 1) <= key), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _input_partitions(df: DataFrame) -> int:
    """An upper estimate of the partitions of ``df`` from its plan's size; runs no job."""
    spark = df.sparkSession
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        split = df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    except AttributeError:  # no plan at hand (Spark Connect): assume a large input
        return 1_000_000
    return max(size // int(split) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _top_k_ok(df: DataFrame, stop: int, top_k_max_rows: int) -> bool:
    return stop * _input_partitions(df) <= top_k_max_rows


@dataclass
class PositionIndex:
    """Monotone bucketing of the order key plus rows per (bucket, sub-bucket).

    ``splits`` are Bucketizer boundaries (``-inf .. +inf``); bucket ``-1`` holds
    NULL keys (they sort first) and bucket ``len(splits) - 1`` holds NaN (sorts
    last). A *hot* key (one that fills at least one bucket's worth of rows, e.g.
    a third of the table) gets a bucket of its own. Only where the counts show that
    a bucket's smallest and largest key are equal, its rows, which the content
    hash (``xxhash64`` of the row) orders then, are cut into ``hot[bucket]``
    contiguous hash ranges, so no window task holds it whole. Where a DOUBLE does not
    tell keys apart (texts, bytes, decimals, integers beyond 53 bits) the inner
    ``splits`` are sampled keys themselves, found by binary search.
    ``counts[(bucket, sub)]`` is the row count of each piece. Rows are ordered
    by ``(key, xxhash64(row))`` everywhere, so repeated keys have one
    deterministic order and positional splits stay exact.
    """

    key: str
    splits: list[float]
    hot: dict[int, int]
    counts: dict[tuple[int, int], int]
    tie_cols: list[str]
    native: bool = False  # ``splits`` are keys between two placeholders

    @property
    def pieces(self) -> list[tuple[int, int]]:
        out = []
        for b in range(-1, len(self.splits)):
            out += [(b, s) for s in range(self.hot.get(b, 1))]
        return out

    @property
    def offsets(self) -> dict[tuple[int, int], int]:
        acc, out = 0, {}
        for p in self.pieces:
            out[p] = acc
            acc += self.counts.get(p, 0)
        return out

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    @classmethod
    def build(cls, df: DataFrame, key: str, num_buckets: int | None = None,
              accuracy: int | None = None, seed: int = 17) -> "PositionIndex":
        """Three narrow jobs over the key column: (1) the row count, (2) a
        quantile sketch of a seeded sample of the key (about
        ``SAMPLES_PER_BUCKET`` keys per bucket, so the sketch merge stays small
        at any partition count; ``num_buckets - 1`` values come back), (3) a
        partially aggregated count per (bucket, sub-bucket). Boundaries only
        balance the buckets; positions come from the exact counts."""
        least = most = None
        if isinstance(df.schema[key].dataType, T.LongType):
            n, least, most = df.agg(F.count(F.lit(1)), F.min(key), F.max(key)).collect()[0]
        else:
            n = df.count()
        nb = num_buckets or min(MAX_BUCKETS, max(16, -(-n // ROWS_PER_BUCKET)))
        if _native(df, key, least, most):
            frac = min(1.0, SPLIT_SAMPLES * nb / max(1, n))
            keys = df.select(key) if frac == 1.0 else df.select(key).sample(withReplacement=False, fraction=frac, seed=seed)
            return cls(key, [None, *_native_splits(keys, key, nb), None], {}, {}, list(df.columns), True)._counted(df, n, nb)
        acc = accuracy or max(10_000, 8 * nb)
        kd = _projection(df, key)
        probs = [i / nb for i in range(1, nb)]
        frac = min(1.0, SAMPLES_PER_BUCKET * nb / max(1, n))
        keys = df.select(kd.alias(_KEYD))
        if frac < 1.0:
            keys = keys.sample(withReplacement=False, fraction=frac, seed=seed)
        kcol = F.col(_KEYD)
        row = keys.agg(F.percentile_approx(F.when(~F.isnan(kcol), kcol), probs, acc)
                       .alias("q")).collect()[0]
        qs = [q for q in (row["q"] or []) if q is not None and math.isfinite(q)]
        reps: dict[float, int] = {}
        for q in qs:
            reps[q] = reps.get(q, 0) + 1
        bounds = set(qs)
        for v, r in reps.items():
            if r >= 2:                       # v alone fills >= 1 bucket: isolate it
                bounds.add(math.nextafter(v, math.inf))
        if not bounds:              # empty / all-NaN key: Bucketizer needs 3 splits
            bounds = {0.0}
        splits = [-math.inf] + sorted(bounds) + [math.inf]
        return cls(key, splits, {}, {}, list(df.columns))._counted(df, n, nb)

    def _counted(self, df: DataFrame, n: int, nb: int) -> "PositionIndex":
        """Exact counts per bucket; buckets of one hot key are cut by hash."""
        k = F.col(self.key)
        found = self._with_bucket(df.select(*self.tie_cols)).groupBy(_BUCKET).agg(
            F.count(F.lit(1)).alias("n"), F.min(k).eqNullSafe(F.max(k)).alias("one_key")).collect()
        self.counts = {(int(r[0]), 0): int(r["n"]) for r in found}
        self.hot = {int(r[0]): -(-int(r["n"]) * nb // n) + 1 for r in found
                    if r["one_key"] and r["n"] * nb >= 2 * n}
        if self.hot:
            cut = self._bucketed(df.select(*self.tie_cols), with_tie=False).filter(F.col(_BUCKET).isin(list(self.hot)))
            self.counts = {p: c for p, c in self.counts.items() if p[0] not in self.hot}
            self.counts |= {(int(r[0]), int(r[1])): int(r[2]) for r in cut.groupBy(_BUCKET, _SUB).count().collect()}
        return self

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        if not self.native:
            return _with_bucket(df, self.key, self.splits)
        b = _search(F.col(self.key), self.splits[1:-1], df.schema[self.key].dataType)
        return df.withColumn(_BUCKET, F.when(F.col(self.key).isNull(), F.lit(-1)).otherwise(b))

    def _bucketed(self, df: DataFrame, with_tie: bool = True) -> DataFrame:
        """Adds bucket, sub-bucket and tie-break columns. The total order is
        ``(key, xxhash64(row))``: deterministic, and it lets repeated keys be cut
        exactly. The count job needs the hash only inside hot buckets."""
        d = self._with_bucket(df)
        tie_all = F.xxhash64(*[F.col(c) for c in self.tie_cols])
        if not self.hot:
            return d.withColumn(_SUB, F.lit(0)).withColumn(
                _TIE, tie_all if with_tie else F.lit(0).cast("long"))
        nsub = F.element_at(_int_array([self.hot.get(b, 1)
                                         for b in range(-1, len(self.splits))]),
                            F.col(_BUCKET) + 2)
        is_hot = nsub > 1
        tie = tie_all if with_tie else F.when(is_hot, tie_all).otherwise(F.lit(0))
        d = d.withColumn(_TIE, tie.cast("long"))
        # Contiguous, monotone ranges of the 64-bit hash.
        frac = (F.col(_TIE).cast("double") / F.lit(_TWO63) + 1.0) / 2.0
        sub = F.least(F.floor(frac * nsub).cast("int"), nsub - 1)
        return d.withColumn(_SUB, F.when(is_hot, sub).otherwise(F.lit(0)))

    def _offset_col(self) -> Column:
        offs = self.offsets
        # Flat piece number = first piece of the bucket + sub-bucket.
        first, n = [], 0
        for b in range(-1, len(self.splits)):
            first.append(n)
            n += self.hot.get(b, 1)
        flat = F.element_at(_int_array(first), F.col(_BUCKET) + 2) + F.col(_SUB)
        arr = _int_array([offs[p] for p in self.pieces])
        return F.element_at(arr, (flat + 1).cast("int"))

    def with_position(self, df: DataFrame, out: str = "pos",
                      bucket_range: tuple[int, int] | None = None) -> DataFrame:
        """Add a 0-based ``out`` position (BIGINT) to every row of ``df``."""
        d = self._bucketed(df)
        if bucket_range is not None:
            d = self._restrict(df, d, *bucket_range)
        w = Window.partitionBy(_BUCKET, _SUB).orderBy(F.col(self.key).asc_nulls_first(),
                                                      F.col(_TIE))
        d = d.withColumn(out, (self._offset_col() + F.row_number().over(w) - 1).cast("long"))
        return d.drop(_BUCKET, _SUB, _TIE)

    def _restrict(self, src: DataFrame, d: DataFrame, lo: int, hi: int) -> DataFrame:
        cond = F.col(_BUCKET).between(lo, hi)
        if self.native:  # the same range on the raw key is pushed into the scan
            k, kind = F.col(self.key), src.schema[self.key].dataType
            point = lambda v: F.lit(bytearray(v) if isinstance(v, bytes) else v).cast(kind)
            if lo > 0:
                d = d.filter(k >= point(self.splits[lo]))
            if hi + 1 < len(self.splits) - 1:
                bound = k < point(self.splits[hi + 1])
                d = d.filter(bound | k.isNull() if lo < 0 else bound)
        elif _numeric(src, self.key):
            # Loose key range on the raw column: pushed into the Parquet scan
            # (row-group pruning); the exact bucket test above keeps it correct.
            k = F.col(self.key)
            lo_v = self.splits[lo] if 0 <= lo < len(self.splits) else -math.inf
            hi_v = self.splits[hi + 1] if -1 <= hi < len(self.splits) - 1 else math.inf
            if lo >= 0 and abs(lo_v) < 2.0 ** 62:
                margin = max(1.0, abs(lo_v) * 2.0 ** -50)
                d = d.filter(k >= F.lit(math.floor(lo_v - margin)))
            if abs(hi_v) < 2.0 ** 62 and hi < len(self.splits) - 1:
                margin = max(1.0, abs(hi_v) * 2.0 ** -50)
                bound = k <= F.lit(math.ceil(hi_v + margin))
                d = d.filter(bound | k.isNull()) if lo < 0 else d.filter(bound)
        return d.filter(cond)

    def buckets_for(self, start: int, stop: int) -> tuple[int, int] | None:
        """Bucket ids whose positions overlap ``[start, stop)``."""
        offs = self.offsets
        hit = [b for (b, s) in self.pieces
               if self.counts.get((b, s), 0) and offs[(b, s)] < stop
               and offs[(b, s)] + self.counts[(b, s)] > start]
        return (min(hit), max(hit)) if hit else None

    def slice(self, df: DataFrame, start: int, stop: int, pos_col: str | None = None) -> DataFrame:
        rng = self.buckets_for(start, stop)
        if rng is None:
            return df.limit(0)
        p = pos_col or "_hearth_pos"
        out = self.with_position(df, p, rng).filter(F.col(p).between(start, stop - 1))
        return out if pos_col else out.drop(p)

    def boundary(self, df: DataFrame, position: int):
        """``(key, tie)`` of the row at ``position``, or ``None`` past the end."""
        rng = self.buckets_for(position, position + 1)
        if rng is None:
            return None
        d = self._bucketed(df)
        d = self._restrict(df, d, *rng)
        w = Window.partitionBy(_BUCKET, _SUB).orderBy(F.col(self.key).asc_nulls_first(),
                                                      F.col(_TIE))
        d = d.withColumn("_p", self._offset_col() + F.row_number().over(w) - 1)
        r = d.filter(F.col("_p") == position).select(self.key, _TIE).collect()[0]
        return r[0], r[1]

    def tie_col(self) -> Column:
        return F.xxhash64(*[F.col(c) for c in self.tie_cols])


def _with_bucket(df: DataFrame, key: str, splits: list[float]) -> DataFrame:
    bz = Bucketizer(splits=splits, inputCol=_KEYD, outputCol=_BUCKET, handleInvalid="keep")
    d = bz.transform(df.withColumn(_KEYD, _projection(df, key)))
    b = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col(_BUCKET).cast("int"))
    return d.withColumn(_BUCKET, b).drop(_KEYD)


# ------------------------------------------------------------------ operators

def head(df: DataFrame, key: str, n: int, top_k_max_rows: int = TOP_K_MAX_ROWS) -> DataFrame:
    """First ``n`` rows by ``key`` (``iloc[:n]``)."""
    return slice_range(df, key, 0, n, top_k_max_rows)


def slice_range(df: DataFrame, key: str, start: int, stop: int,
                top_k_max_rows: int = TOP_K_MAX_ROWS,
                index: PositionIndex | None = None) -> DataFrame:
    """Rows at positions ``[start, stop)`` by ``key``; past-the-end clips (no error)."""
    start, stop = max(0, int(start)), int(stop)
    if stop <= start:
        return df.limit(0)
    if index is None and _top_k_ok(df, stop, top_k_max_rows):
        # same total order as the index route: key, then the row's content hash
        out = df.orderBy(F.col(key).asc_nulls_first(), F.xxhash64(*[F.col(c) for c in df.columns]))
        if start:
            out = out.offset(start)
        return out.limit(stop - start)
    index = index or PositionIndex.build(df, key)
    return index.slice(df, start, stop)


def row_at(df: DataFrame, key: str, position: int, **kw) -> DataFrame:
    """The row at ``position`` (``iloc[i]``); empty when past the end."""
    return slice_range(df, key, position, position + 1, **kw)


def split_positional(df: DataFrame, key: str, parts: list[tuple[str, int, int]],
                     out: str = "split", **kw) -> DataFrame:
    """Disjoint positional splits, e.g. ``[('train', 0, 160), ('test', 160, 200)]``,
    tagged with ``out``."""
    pieces = [slice_range(df, key, a, b, **kw).withColumn(out, F.lit(name))
              for name, a, b in parts]
    res = pieces[0]
    for p in pieces[1:]:
        res = res.unionByName(p)
    return res


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def with_batch(df: DataFrame, key: str, batch_size: int, out: str = "batch_id",
               index: PositionIndex | None = None, keep_position: bool = False) -> DataFrame:
    """Consecutive mini-batches by ``key``: ``batch_id = position div batch_size``;
    the last batch may be short."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    index = index or PositionIndex.build(df, key)
    d = index.with_position(df, "pos")
    d = d.withColumn(out, F.floor(F.col("pos") / F.lit(batch_size)).cast("long"))
    return d if keep_position else d.drop("pos")


def batch_summary(df: DataFrame, key: str, batch_size: int,
                  index: PositionIndex | None = None) -> DataFrame:
    """One row per batch: size and first / last key."""
    b = with_batch(df.select(key), key, batch_size, index=index)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.min(key).alias("first_key"),
                                     F.max(key).alias("last_key"))


def split_predicates(df: DataFrame, key: str, fraction: float,
                     index: PositionIndex | None = None,
                     top_k_max_rows: int = TOP_K_MAX_MERGE_ROWS) -> tuple[Column, Column]:
    """``(first, rest)`` predicates for the first ``floor(fraction * n)`` rows by
    ``key`` and the remainder. Positions are monotone in the key, so each side is
    a comparison with the key at the boundary position: a filter that reaches the
    Parquet scan, with no shuffle of the table. Rows sharing the boundary key are
    divided by their content hash, so the split stays exact with repeated (hot)
    keys. A shallow boundary (``position x input partitions`` within
    ``top_k_max_rows``) is found with a count and a bounded top-k; any other
    through the :class:`PositionIndex`."""
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    if index is None:
        n = df.count()
        p = int(math.floor(fraction * n))
        if p >= n:
            return F.lit(True), F.lit(False)
        if _top_k_ok(df, p + 1, top_k_max_rows):
            r = df.select(F.col(key).alias("_k"), tie.alias("_t")) \
                .orderBy(F.col("_k").asc_nulls_first(), "_t").offset(p).limit(1).collect()[0]
            bk, btie = r[0], r[1]
            return _split_on(key, bk, btie, tie)
        index = PositionIndex.build(df, key)
    b = index.boundary(df, int(math.floor(fraction * index.total)))
    if b is None:
        return F.lit(True), F.lit(False)
    return _split_on(key, b[0], b[1], tie)


def _split_on(key: str, bk, btie, tie: Column) -> tuple[Column, Column]:
    """Predicates around the boundary row ``(bk, btie)``. Each carries a plain key
    range as its own conjunct, so the range reaches the Parquet scan; the hash
    comparison only decides rows whose key equals the boundary key."""
    k = F.col(key)
    if bk is None:          # boundary among NULL keys (they sort first)
        first = k.isNull() & (tie < F.lit(btie))
        return first, ~first
    if btie is None:
        return k.isNull() | (k < F.lit(bk)), k >= F.lit(bk)
    first = (k.isNull() | (k <= F.lit(bk))) & \
        (k.isNull() | (k < F.lit(bk)) | (tie < F.lit(btie)))
    rest = (k >= F.lit(bk)) & ((k > F.lit(bk)) | (tie >= F.lit(btie)))
    return first, rest


def split_fraction(df: DataFrame, key: str, fraction: float, names=("train", "test"),
                   out: str = "split", index: PositionIndex | None = None) -> DataFrame:
    """The same split as a column (``names[0]`` / ``names[1]``)."""
    first, _ = split_predicates(df, key, fraction, index)
    return df.withColumn(out, F.when(first, F.lit(names[0])).otherwise(F.lit(names[1])))


def first_batch(df: DataFrame, key: str, batch_size: int) -> DataFrame:
    """``next(iter(loader))``: the first ``batch_size`` rows."""
    return head(df, key, batch_size)

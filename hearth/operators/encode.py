"""Text -> fixed-length ids with an attention mask, as Spark jobs.

Tokens are lower-cased whitespace words. The vocabulary is built from the corpus
(``explode`` -> ``groupBy(token).count`` with map-side partial counts -> top-V by
``(count desc, token asc)``). Encoding truncates *before* exploding, looks ids up
through a hash join on the vocabulary (broadcast when its row bound allows) and
regroups per document; partial aggregation keeps that exchange at about one row
per document. Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hearth.functions.text import tokenize

# Reserved ids.
PAD_ID, UNK_ID, BEGIN_ID, END_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
DEFAULT_MAX_LEN = 512

# The vocabulary is broadcast (map-only lookup) only when its measured size is at
# most this many bytes. A larger one takes the join route, where its most
# frequent HEAD_VOCAB_ROWS tokens (the hot keys) are still broadcast and only
# the rare tail is joined through a shuffle.
BROADCAST_VOCAB_MAX_BYTES = 64 * 1024 * 1024
HEAD_VOCAB_ROWS = 200_000
# Slots that rank their tokens side by side when a vocabulary is built.
VOCAB_SLOTS = 512


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, _n_tokens(text).alias("n_tokens"))


def build_vocab(df: DataFrame, text: str, size: int) -> DataFrame:
    """Top-``size`` tokens as ``(token, id, n)``; ids start after the reserved ones.
    Ties in count are broken by the token (byte order)."""
    if size <= 0:
        raise ValueError("vocabulary size must be positive")
    counts = df.select(F.explode(tokenize(text)).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("token").asc()]
    # Each of VOCAB_SLOTS slots of the tokens keeps its own top, so the last merge reads
    # VOCAB_SLOTS x size rows at most, however many partitions and tokens there are.
    in_slot = Window.partitionBy(F.pmod(F.hash("token"), F.lit(VOCAB_SLOTS))).orderBy(*order)
    kept = counts.withColumn("_r", F.row_number().over(in_slot)).filter(F.col("_r") <= size)
    top = kept.select("token", "n").orderBy(*order).limit(size)
    # The window runs over at most `size` rows (the top-k output).
    return top.withColumn("id", (F.row_number().over(Window.orderBy(*order))
                                 + (FIRST_WORD_ID - 1)).cast("int")) \
        .select("token", "id", F.col("n").cast("long").alias("n"))


def vocab_bytes(vocab: DataFrame) -> int:
    """Measured size of a vocabulary (UTF-8 token bytes + id/count per row).
    Cheap on a materialised vocabulary: it reads at most ``size`` rows."""
    r = vocab.agg(F.coalesce(F.sum(F.octet_length("token") + 16), F.lit(0))).collect()[0][0]
    return int(r)


def prepare_vocab(df: DataFrame, text: str, size: int) -> tuple[DataFrame, int | None]:
    """Build the vocabulary once, write it under the shared checkpoint folder
    (encode once, reuse for every encoding job) and measure it, so the lookup
    can be broadcast on a proven size. Returns ``(vocab, bytes)``. A cluster must name
    the shared folder in ``spark.checkpoint.dir``; without one this raises."""
    import uuid

    from hearth.sources.sinks import materialise
    vocab = materialise(build_vocab(df, text, size), f"vocab-{uuid.uuid4().hex}")
    return vocab, vocab_bytes(vocab)


def _check_len(max_len: int) -> None:
    if max_len < 2:
        raise ValueError("max_len must leave room for the begin and end ids (>= 2)")


def truncation_report(df: DataFrame, key: str, text: str,
                      max_len: int = DEFAULT_MAX_LEN) -> DataFrame:
    """Per row: tokens before truncation, tokens kept (``max_len - 2`` at most),
    and whether it was truncated."""
    _check_len(max_len)
    n = F.size(tokenize(text))
    return df.select(key, n.alias("n_tokens")) \
        .withColumn("n_kept", F.least(F.col("n_tokens"), F.lit(max_len - 2))) \
        .withColumn("truncated", F.col("n_tokens") > F.lit(max_len - 2))


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame,
           max_len: int = DEFAULT_MAX_LEN, keep: Sequence[str] = (),
           vocab_size_bytes: int | None = None, route: str = "auto") -> DataFrame:
    """``key, *keep, n_tokens, input_ids ARRAY<INT>[max_len], attention_mask
    ARRAY<INT>[max_len]``. Rows with no token keep a row: begin + end + padding.

    ``vocab_size_bytes`` is the measured size of ``vocab`` (see
    :func:`prepare_vocab`). Within ``BROADCAST_VOCAB_MAX_BYTES`` the lookup is
    map-only (``route='lookup'``): the vocabulary is broadcast and each Arrow
    batch of token lists is mapped with a vectorised hash lookup, with no explode,
    shuffle or regroup. A larger (or unmeasured) vocabulary uses the join route
    (``route='join'``): broadcast join when measured small, else a broadcast
    head of hot tokens plus a shuffle join for the rare tail
    (``route='split-join'`` forces that form). All routes give identical ids.
    """
    _check_len(max_len)
    small = vocab_size_bytes is not None and vocab_size_bytes <= BROADCAST_VOCAB_MAX_BYTES
    if route == "lookup" or (route == "auto" and small):
        return _encode_lookup(df, key, text, vocab, max_len, list(keep))
    return _encode_join(df, key, text, vocab, max_len, list(keep),
                        small and route != "split-join")


def _encode_lookup(df: DataFrame, key: str, text: str, vocab: DataFrame, max_len: int,
                   keep: list[str]) -> DataFrame:
    # The vocabulary is a parameter of measured size: its tokens, ordered by id,
    # are broadcast once per executor.
    pairs = [(r[0], int(r[1])) for r in vocab.orderBy("id").select("token", "id").collect()]
    tokens = [t for t, _ in pairs]
    first_id = pairs[0][1] if pairs else FIRST_WORD_ID
    if any(i != first_id + k for k, (_, i) in enumerate(pairs)) or len(set(tokens)) != len(tokens):
        # ids not consecutive in token order, or repeated tokens: join route
        return _encode_join(df, key, text, vocab, max_len, keep, True)
    try:
        shipped = df.sparkSession.sparkContext.broadcast(tokens)
        get_tokens = lambda: shipped.value
    except Exception:  # no SparkContext (e.g. Spark Connect): ship with the UDF
        get_tokens = lambda: tokens
    ids_udf = _ids_udf(get_tokens, int(first_id), max_len)
    base = _tokens_once(df, key, text, keep, max_len)
    return base.select(key, *keep, "n_tokens", ids_udf(F.col("_kept")).alias("input_ids"),
                       _mask(F.size("_kept"), max_len).alias("attention_mask"))


def _mask(n: Column, max_len: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), n + 2), F.array_repeat(F.lit(0), F.lit(max_len - 2) - n))


def attention_mask(df: DataFrame, key: str, text: str, max_len: int = DEFAULT_MAX_LEN,
                   keep: Sequence[str] = ()) -> DataFrame:
    """``key, *keep, n_tokens, attention_mask`` as :func:`encode` gives them. The mask needs
    the token count alone: no vocabulary, no shuffle."""
    _check_len(max_len)
    counted = df.select(key, *keep, _n_tokens(text).alias("n_tokens"))
    return counted.withColumn("attention_mask", _mask(F.least(F.col("n_tokens"), F.lit(max_len - 2)), max_len))


def _tokens_once(df: DataFrame, key: str, text: str, keep: list[str],
                 max_len: int) -> DataFrame:
    """``key, *keep, n_tokens, _kept``: the text is tokenised once, in its own
    projection. ``n_tokens`` and ``_kept`` both read that column; the optimizer
    keeps it (it is referenced twice and is not cheap), so neither the Python
    evaluation node nor the explode re-tokenises."""
    # a NULL text has no tokens, on every route
    toks = F.coalesce(tokenize(text), F.array().cast("array<string>"))
    t = df.select(key, *keep, toks.alias("_toks"))
    return t.select(key, *keep, F.size("_toks").alias("n_tokens"),
                    F.slice("_toks", 1, max_len - 2).alias("_kept"))


def _ids_udf(get_tokens, first_id: int, max_len: int):
    cache: dict = {}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def _ids(col: pa.Array) -> pa.Array:
        import pyarrow.compute as pc
        if "ids" not in cache:  # one table per Python worker, not one per batch
            cache["ids"] = {t: first_id + k for k, t in enumerate(get_tokens())}
        n, known = len(col), cache["ids"]
        lens = np.asarray(pc.fill_null(pc.list_value_length(col), 0)
                          .to_numpy(zero_copy_only=False), dtype=np.int64)
        words = col.flatten().dictionary_encode()  # each distinct word of the batch is looked up once
        table = np.array([known.get(t, UNK_ID) for t in words.dictionary.to_pylist()], dtype=np.int32)
        ids = table[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.int32)
        out = np.full((n, max_len), PAD_ID, dtype=np.int32)
        out[:, 0] = BEGIN_ID
        rows = np.repeat(np.arange(n), lens)
        starts = np.repeat(np.cumsum(lens) - lens, lens)
        out[rows, np.arange(len(ids)) - starts + 1] = ids
        out[np.arange(n), lens + 1] = END_ID
        offsets = pa.array(np.arange(0, (n + 1) * max_len, max_len, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return _ids


def _encode_join(df: DataFrame, key: str, text: str, vocab: DataFrame, max_len: int,
                 keep: list[str], broadcast_vocab: bool) -> DataFrame:
    """Explode -> hash join on the vocabulary -> regroup per row.

    For a vocabulary too large to broadcast, a token like "the" can be a third
    of all exploded rows, and a plain shuffle join would send it to one task.
    Ids are ranked by frequency, so the hot tokens are exactly the first ids:
    the head (``HEAD_VOCAB_ROWS`` rows, bounded) is broadcast, and only tokens
    it does not resolve (rare by construction) are joined to the tail through a
    shuffle. The regroup is keyed by a per-row id, so every group holds at most
    ``max_len - 2`` tokens even if ``key`` repeats; partial aggregation
    completes it map-side."""
    # Row identity for the regroup: partition index + offset of the row in its
    # input split, stable when a lost task re-reads the same split.
    base = _tokens_once(df.withColumn("_rid", F.monotonically_increasing_id()), key, text,
                        keep + ["_rid"], max_len)
    ex = base.select(key, *keep, "_rid", "n_tokens",
                     F.posexplode_outer("_kept").alias("_pos", "_tok"))
    v = vocab.select(F.col("token").alias("_tok"), F.col("id").alias("_id"))
    if broadcast_vocab:
        j = ex.join(F.broadcast(v), "_tok", "left")
    else:
        first = vocab.agg(F.min("id")).collect()[0][0]
        cut = (first if first is not None else FIRST_WORD_ID) + HEAD_VOCAB_ROWS
        head = F.broadcast(v.filter(F.col("_id") < cut))
        tail = v.filter(F.col("_id") >= cut)
        h = ex.join(head, "_tok", "left")
        resolved = h.filter(F.col("_id").isNotNull() | F.col("_tok").isNull())
        rest = h.filter(F.col("_id").isNull() & F.col("_tok").isNotNull()).drop("_id") \
            .join(tail, "_tok", "left")
        j = resolved.unionByName(rest)
    item = F.when(F.col("_pos").isNotNull(),
                  F.struct(F.col("_pos"), F.coalesce(F.col("_id"), F.lit(UNK_ID)).alias("_id")))
    g = j.groupBy("_rid", key, *keep, "n_tokens") \
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
    ids = F.col("_items._id")   # field of an array of structs: no lambda
    return g.select(key, *keep, "n_tokens", ids.alias("_ids")) \
        .withColumn("_n", F.size("_ids")) \
        .select(key, *keep, "n_tokens", *_pad_and_mask(F.col("_ids"), F.col("_n"), max_len))


def _pad_and_mask(ids, n, max_len: int):
    pad = F.lit(max_len - 2) - n
    input_ids = F.concat(F.array(F.lit(BEGIN_ID)), ids, F.array(F.lit(END_ID)),
                         F.array_repeat(F.lit(PAD_ID), pad))
    return input_ids.alias("input_ids"), _mask(n, max_len).alias("attention_mask")


def empty_inputs(df: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """Rows whose text has no token (they would encode to begin + end only).
    ``strict`` turns the first such row into an error instead of a report."""
    n = _n_tokens(text)
    out = df.select(key, n.alias("n_tokens")).filter(F.col("n_tokens") == 0)
    if strict:  # in a filter, so that no plan can leave the check out
        out = out.filter(F.raise_error(F.concat(
            F.lit("empty input for key "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))).cast("boolean"))
    return out


def _n_tokens(text) -> Column:
    """Tokens of a text; a NULL text has none."""
    return F.greatest(F.coalesce(F.size(tokenize(text)), F.lit(0)), F.lit(0))


def empty_input_summary(df: DataFrame, text: str) -> DataFrame:
    n = _n_tokens(text)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count(F.when(n == 0, 1)).alias("n_empty"))


def map_batches(df: DataFrame, fn: Callable, new_fields: Sequence[T.StructField]) -> DataFrame:
    """Batched row function over Arrow batches (``ds.map(fn, batched=True)``):
    ``fn(pandas.DataFrame) -> dict | DataFrame`` of new columns; input columns are
    kept, the new ones appended."""
    out_schema = T.StructType(list(df.schema.fields) + list(new_fields))
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in new_fields]

    def run(batches):
        import pyarrow as pa
        for b in batches:
            res = fn(b.to_pandas())  # input columns pass through as Arrow, untouched
            new = [pa.array(list(res[n]), t, from_pandas=True) for n, t in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(n for n, _ in kinds)])

    return df.mapInArrow(run, out_schema)

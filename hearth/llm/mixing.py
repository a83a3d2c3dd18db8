"""Mixing sources to target weights (native DataFrame operations only).

Every document gets a hash-random key; documents are range-sorted by it within their
source, distributed prefix sums of the sizes are taken, and each source is cut at its
budget. A budget above the source's size repeats whole epochs and cuts the last one.

Documents are taken whole: of the last epoch a source takes the documents whose
middle lies before the budget, which misses the target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm.common import WORD, Scratch, hashed_bucket

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # all sources together take 150 % of all sizes
MAX_EPOCHS = 2  # a target stops at 2 times its source's size
SMALL_ROWS = 50_000  # a table of fewer rows, each under 300 bytes, is broadcast


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``totals (source, n_docs, source_size)`` plus ``target``.

    Sources by code point (null last) weigh ``weights``, repeating. A target is
    ``min(max_epochs * size, level * weight)`` with the one level at which the targets
    add up to the share: what capped sources leave is reshared by weight until none
    is above its cap. In the order of cap / weight the capped sources come first. With
    the first i of them capped, the rest share what is left at level(i), which rises
    while the next source is above its cap and falls after: the level is the largest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("weight", F.element_at(
        F.array(*[F.lit(x).cast("long") for x in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * max_epochs)
    ratio = F.col("cap") / F.col("weight")
    by_ratio = Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (w.withColumn("want", F.sum("source_size").over(everything) * share[0])
         .withColumn("level", (F.col("want") - share[1] * F.coalesce(F.sum("cap").over(before), F.lit(0)))
                     / (share[1] * F.sum("weight").over(onward)).cast("double")))
    level = F.max("level").over(everything)
    return w.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select(
        "source", "n_docs", "source_size", "target")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def mix(df: DataFrame, size: Column, scratch: Scratch, key: list[str], source: str = "source",
        seed: int = 0) -> DataFrame:
    """Every row of ``df`` with ``_size``, ``_source_size``, ``_target`` and ``_epochs``
    (how many times the mix takes the row: 0 up to ``MAX_EPOCHS``).

    The random order follows ``md5(seed:key columns)``, then the size, so reruns agree
    and repeated rows are told apart by position only. A null source is a source of its
    own; rows without words are taken as often as their neighbours but add nothing;
    an empty table gives no rows. Columns of ``df`` may have any names but ``_mix_*``.
    """
    text_key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(f"_mix_row.`{k}`").cast("string"), F.lit(""))
                                                   for k in key])
    rows = df.select(F.struct("*").alias("_mix_row"), size.alias("_mix_size"), F.col(source).alias("_mix_source"))
    rows = scratch.save(rows.withColumn("_mix_key", F.md5(text_key)), "sized")

    totals = rows.groupBy(F.col("_mix_source").alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum("_mix_size").alias("source_size"))
    targets = scratch.save(source_targets(totals), "targets")
    n_sources = targets.count()

    t = _small(targets.select(F.col("source").alias("_mix_s"), "n_docs", "source_size", "target"), n_sources)
    fraction = F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("long") / F.lit(2.0 ** 32)
    rows = (rows.join(t, F.col("_mix_source").eqNullSafe(F.col("_mix_s")))
            .withColumn("_mix_bucket", hashed_bucket(fraction, F.col("n_docs"))))
    sums = rows.groupBy("_mix_s", "_mix_bucket").agg(F.sum("_mix_size").alias("sum"))
    earlier = (Window.partitionBy("_mix_s").orderBy("_mix_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = scratch.save(sums.select(F.col("_mix_s").alias("_mix_os"), F.col("_mix_bucket").alias("_mix_ob"),
                                       F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset")), "offsets")
    rows = rows.join(_small(offsets, offsets.count()),
                     F.col("_mix_s").eqNullSafe(F.col("_mix_os")) & (F.col("_mix_bucket") == F.col("_mix_ob")))
    within = (Window.partitionBy("_mix_s", "_mix_bucket").orderBy("_mix_key", "_mix_size")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.col("offset") + F.coalesce(F.sum("_mix_size").over(within), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("_mix_start", start).withColumn("_mix_whole", whole.cast("long"))
    rest = F.col("target") - F.col("_mix_whole") * F.col("source_size")
    epochs = F.col("_mix_whole") + F.when(2 * F.col("_mix_start") + F.col("_mix_size") <= 2 * rest, 1).otherwise(0)
    return rows.select("_mix_row.*", F.col("_mix_size").alias("_size"), F.col("source_size").alias("_source_size"),
                       F.col("target").alias("_target"), F.least(epochs, F.lit(MAX_EPOCHS)).alias("_epochs"))

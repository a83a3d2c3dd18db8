"""Keyed-snapshot operators: key normalisation, last write wins, overlay of one
snapshot on another, strict key check, weighted flagged share.

Both snapshots are reduced to one row per key by an aggregation on the key, so
the overlay / drift joins that follow reuse that hash partitioning (no second
exchange). ``max_by`` aggregates partially, so a key holding a third of all rows
still sends one candidate per task through the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.text import strip_literals


def normalise_keys(df: DataFrame, col: str, literals: Sequence[str], out: str = "key") -> DataFrame:
    """Remove literal substrings (all occurrences, in the given order)."""
    return df.withColumn(out, strip_literals(col, literals))


def last_write_wins(df: DataFrame, key: str, values: Sequence[str], order: str) -> DataFrame:
    """One row per key: the values of the row with the greatest ``order``
    (rebuilding a map in source order, later writes overwrite)."""
    packed = F.struct(*[F.col(v) for v in values])
    # equal order values: the larger content hash wins, whatever the task order
    last = F.struct(F.col(order), F.xxhash64(*[F.col(v) for v in values]))
    agg = df.groupBy(key).agg(F.max_by(packed, last).alias("_v"),
                              F.max(order).alias(order))
    return agg.select(key, *[F.col(f"_v.{v}").alias(v) for v in values], order)


def _match(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Equi-join on ``key``. Both sides come out of an aggregation on ``key``, so
    the join reuses that hash partitioning with no further exchange. SQL NULL
    semantics apply: a NULL key matches nothing (it is reported as drift); a
    null-safe join would re-partition both sides on ``coalesce(key)``."""
    return left.join(right, key, how)


def overlay(base: DataFrame, updates: DataFrame, key: str, values: Sequence[str],
            strict: bool = False) -> DataFrame:
    """Load ``updates`` onto ``base``: the base key set, with values replaced where
    the update has the key (even by a NULL value). Both inputs must have one row
    per key (use :func:`last_write_wins` first). ``strict`` raises on missing or
    unexpected keys."""
    b = base.select(key, F.lit(True).alias("_in_b"),
                    *[F.col(v).alias(f"_b_{v}") for v in values])
    u = updates.select(key, F.lit(True).alias("_in_u"),
                       *[F.col(v).alias(f"_u_{v}") for v in values])
    if strict:
        j = _match(b, u, key, "full_outer")
        bad = F.col("_in_b").isNull() | F.col("_in_u").isNull()
        # in a filter, so that no plan (a count, say) can leave the check out
        drift = F.concat(F.lit("key drift on "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
        j = j.filter(F.when(bad, F.raise_error(drift).cast("boolean")).otherwise(F.lit(True)))
    else:
        j = _match(b, u, key, "left")
    hit = F.coalesce(F.col("_in_u"), F.lit(False))
    return j.select(key, *[F.when(hit, F.col(f"_u_{v}")).otherwise(F.col(f"_b_{v}")).alias(v)
                           for v in values], hit.alias("from_update"))


def key_drift(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``(key, status)`` with status ``'missing'`` (in base, not in updates) or
    ``'unexpected'`` (in updates, not in base): one full outer join."""
    b = base.select(key).distinct().withColumn("_in_b", F.lit(True))
    u = updates.select(key).distinct().withColumn("_in_u", F.lit(True))
    j = _match(b, u, key, "full_outer")
    status = F.when(F.col("_in_u").isNull(), F.lit("missing")) \
        .when(F.col("_in_b").isNull(), F.lit("unexpected"))
    return j.select(key, status.alias("status")).filter(F.col("status").isNotNull())


def flagged_share(df: DataFrame, flag: str, weight: str | None = None) -> DataFrame:
    """``(n_flagged, n_total, share)``: weighted by ``weight`` (e.g. parameter
    counts) or by row."""
    w = F.col(weight) if weight else F.lit(1)
    return df.agg(F.coalesce(F.sum(F.when(F.col(flag), w).otherwise(0)), F.lit(0))
                  .cast("long").alias("n_flagged"),
                  F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("n_total")) \
        .withColumn("share", F.when(F.col("n_total") > 0,
                                    F.col("n_flagged") / F.col("n_total")))

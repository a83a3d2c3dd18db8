"""Projection-level operators: renaming columns, constant columns,
score write-back, label correction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant columns, e.g. ``{'new_result': '', 'new_score': 0.0}``."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


SCORE_DEFAULTS = {"new_result": "", "new_score": 0.0}


def assemble_record(df: DataFrame, text: str, label: str, key: str | None = None) -> DataFrame:
    """Model-input record: ``sentence`` and ``labels`` (renamed from ``label``)."""
    cols = ([F.col(key).alias("idx")] if key else []) + [
        F.col(text).alias("sentence"), F.col(label).alias("labels")]
    return df.select(*cols)


def write_back(base: DataFrame, scores: DataFrame, key: str,
               defaults: Mapping[str, object] = SCORE_DEFAULTS) -> DataFrame:
    """Left join the score table onto ``base`` by ``key``; rows without a score
    keep the defaults. No side is forced into a broadcast: the measured size of the
    score table decides at run time."""
    s = scores.select(key, *[F.col(c).alias(f"_s_{c}") for c in defaults])
    joined = base.drop(*[c for c in defaults if c in base.columns]).join(s, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_s_{c}"), F.lit(v))
                               for c, v in defaults.items()}) \
        .drop(*[f"_s_{c}" for c in defaults])


def swap_labels(df: DataFrame, label: str, out: str | None = None) -> DataFrame:
    """Correct a 0/1 label that was stored reversed; other values are kept."""
    c = F.col(label)
    return df.withColumn(out or label, F.when(c.isin(0, 1), F.lit(1) - c).otherwise(c))

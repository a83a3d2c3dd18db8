"""Scoring a feature table with a classifier head.

A head is ``logits = W2 (W1 x + b1) + b2`` with no activation between the two
affine maps, so it is folded into one matrix before it enters the plan. Weight
matrices are parameters of size classes x width; they are literals in the plan
and every row is scored in the JVM with ``transform`` / ``aggregate``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.functions.arrays import argmax, has_nan
from hearth.operators.vectors import fold_affine, project

# A row with this label has no loss, as the loss functions of training libraries have it.
IGNORE_LABEL = -100


def head_logits(df: DataFrame, features: str, weights, bias=None,
                out: str = "logits") -> DataFrame:
    """Add ``out = W x + b`` (``ARRAY<DOUBLE>``). ``weights`` may be a list of
    ``(W, b)`` pairs applied in order; they are folded into one affine map."""
    if isinstance(weights, list) and weights and isinstance(weights[0], tuple):
        w, b = fold_affine(weights)
    else:
        w, b = np.asarray(weights, dtype=float), bias
    return project(df, features, w, b, out=out)


def stacked_logits(df: DataFrame, features: str, heads: Sequence, keep: Sequence[str],
                   head_col: str = "head", out: str = "logits") -> DataFrame:
    """Score every row with several heads in one pass: the heads (same class
    count) are stacked into one matrix, applied once, and the result is split
    into one row per (row, head) with ``head`` = 0..n-1.

    ``heads`` is a list of ``W`` or ``(W, b)``; a head reading only part of the
    vector (a layer view) is a ``W`` with zeros outside that part.
    """
    ws, bs = [], []
    for h in heads:
        w, b = (h if isinstance(h, tuple) else (h, None))
        w = np.asarray(w, dtype=float)
        ws.append(w)
        bs.append(np.zeros(w.shape[0]) if b is None else np.asarray(b, dtype=float))
    k = ws[0].shape[0]
    if any(w.shape[0] != k for w in ws):
        raise ValueError("stacked heads must have the same number of classes")
    allw = project(df.select(*dict.fromkeys(list(keep) + [features])), features,
                   np.vstack(ws), np.concatenate(bs), out="_all")
    parts = F.array(*[F.slice(F.col("_all"), i * k + 1, k) for i in range(len(ws))])
    # outer: the array is never empty, and no filter is inferred above the matmul
    return allw.select(*keep, F.posexplode_outer(parts).alias(head_col, out))


def class_name_col(pred: Column, class_names: Mapping[int, str] | Sequence[str],
                   strict: bool = False) -> Column:
    """Map a class id to its name through a literal map. Unknown ids give NULL,
    or an error when ``strict``."""
    items = class_names.items() if isinstance(class_names, Mapping) else enumerate(class_names)
    m = F.create_map(*[x for k, v in items for x in (F.lit(int(k)), F.lit(str(v)))])
    name = F.element_at(m, pred)
    if strict:
        name = F.when(pred.isNull() | name.isNotNull(), name).otherwise(
            F.raise_error(F.concat(F.lit("unknown class id "), pred.cast("string"))))
    return name


def score(df: DataFrame, logits: str = "logits", label: str | None = None,
          class_names=None, strict: bool = False, probabilities: bool = False) -> DataFrame:
    """Arg-max class (first on ties, over *all* classes), its probability, and the
    per-row cross-entropy when a label column is given.

    Adds ``pred`` (INT), ``score`` (DOUBLE), optionally ``probs``, ``pred_name``
    and ``nll``. Rows with a NULL label are scored; their ``nll`` is NULL.
    ``strict`` rejects NaN logits instead of ranking NaN highest.
    """
    l = F.col(logits)
    if strict:
        l = F.when(~has_nan(l), l).otherwise(F.raise_error(F.lit("NaN in logits")))
    # Row max and sum(exp(l - max)) are computed once, as columns: two lambdas
    # with the same body are not merged by subexpression elimination.
    out = df.withColumn("_m", F.array_max(l))
    m = F.col("_m")
    out = out.withColumn("_se", F.aggregate(F.col(logits), F.lit(0.0),
                                            lambda acc, v: acc + F.exp(v - m)))
    se = F.col("_se")
    out = out.withColumn("pred", argmax(logits)).withColumn("score", F.lit(1.0) / se)
    if probabilities:
        out = out.withColumn("probs", F.transform(F.col(logits), lambda v: F.exp(v - m) / se))
    if class_names is not None:
        out = out.withColumn("pred_name", class_name_col(F.col("pred"), class_names, strict))
    if label is not None:
        # log-sum-exp shifted by the row max, minus the logit of the true class.
        y = F.col(label).cast("int")
        known = (y >= 0) & (y < F.size(F.col(logits)))
        out = out.withColumn("nll", F.when(known, m + F.log(se) - F.get(F.col(logits), y)).when(
            y.isNotNull() & (y != IGNORE_LABEL) & F.col(logits).isNotNull(),
            F.raise_error(F.concat(F.lit("label out of range: "), y.cast("string"))).cast("double")))
    return out.drop("_m", "_se")


def classify_struct(df: DataFrame, logits: str, class_names, out: str = "result") -> DataFrame:
    """Pipeline-style output: ``struct(label: STRING, score: DOUBLE)``."""
    s = score(df, logits, class_names=class_names)
    return s.withColumn(out, F.struct(F.col("pred_name").alias("label"),
                                      F.col("score").alias("score"))) \
        .drop("pred", "score", "pred_name")


def score_table(df: DataFrame, features: str, weights, bias=None, label: str | None = None,
                class_names=None, strict: bool = False) -> DataFrame:
    """Batch scoring of a whole table: logits -> pred / score / nll."""
    return score(head_logits(df, features, weights, bias), "logits", label,
                 class_names, strict)


def score_with_fn(df: DataFrame, make_scorer: Callable[[], Callable], inputs: Sequence[str],
                  num_classes: int, keep: Sequence[str] = ()) -> DataFrame:
    """Run a user forward function over Arrow batches.

    ``make_scorer()`` is called once per task (load weights / a model there);
    the returned callable maps a dict of numpy arrays (one per input column) to a
    ``(rows, num_classes)`` logits array. Output: ``keep`` columns + ``logits``.
    """
    keep = list(keep)
    in_schema = df.select(*keep).schema
    out_schema = T.StructType(list(in_schema.fields) + [
        T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import numpy as _np
        import pyarrow as _pa
        fn = make_scorer()
        for b in batches:
            pdf = b.select(list(inputs)).to_pandas()
            # rows with a NULL input get NULL logits; the scorer sees the rest
            ok = _np.ones(len(pdf), dtype=bool)
            for c in inputs:
                ok &= pdf[c].notna().to_numpy()
            z = _np.zeros((0, num_classes))
            if ok.any():
                sub = pdf[ok]
                feats = {c: _np.stack(sub[c].to_numpy()) if sub[c].dtype == object
                         else sub[c].to_numpy() for c in inputs}
                z = _np.asarray(fn(feats), dtype=float).reshape(len(sub), num_classes)
            ends = _np.concatenate([[0], _np.cumsum(ok * num_classes)]).astype(_np.int32)
            lists = _pa.ListArray.from_arrays(_pa.array(ends), _pa.array(z.ravel()), mask=_pa.array(~ok))
            # kept columns pass through as Arrow, untouched
            yield _pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], names=[*keep, "logits"])

    return df.select(*dict.fromkeys(keep + list(inputs))).mapInArrow(run, out_schema)

"""Fitting a classifier head on frozen features.

* Closed form (minimum-norm least squares, ``W = pinv(X) Y``): every task reduces its Arrow
  batches to the triangle of ``[X | Y]`` (:mod:`hearth.operators.tsqr`), triangles merge in a
  tree, and ``W`` is solved from the last one: on the driver for one head, on the executors
  for one head per group. ``X^T X`` is never formed for a fit, so its condition isn't squared.
* Gram sums ``X^T [X | Y]`` as a table of their own, and as the curvature bound of fit rounds.
* Iterative (softmax head): Spark ML multinomial ``LogisticRegression``; each
  iteration is one distributed aggregation. Rounds that continue from one another take
  curvature-bounded gradient steps, one distributed pass each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.operators import tsqr

GRAM_ROW_SCHEMA = T.StructType([
    T.StructField("grp", T.StringType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("slot", T.IntegerType()),
    T.StructField("row", T.ArrayType(T.DoubleType())),
])

# Partial sums meet in this many slots first (400k tasks: about 800 rows a key, then 512).
MERGE_SLOTS = 512


def gram_rows(df: DataFrame, features: str, label: str, num_classes: int,
              group: str | None = None) -> DataFrame:
    """``(grp, i, row)`` with ``row[j] = sum_rows x_i * z_j`` where
    ``z = [x | one_hot(label)]``: ``j < d`` is ``X^T X``, ``j >= d`` is ``X^T Y``.

    Each task emits ``d`` wide rows per group (its partial sums). They are added
    element-wise in the JVM (Spark ML's ``Summarizer.sum``) in two levels: first per
    ``(grp, i, slot)``, the slot being the task's number modulo ``MERGE_SLOTS``, then per
    ``(grp, i)``. No key receives one row per task: a slot gets ``tasks / MERGE_SLOTS``
    rows, the last level at most ``MERGE_SLOTS``. Unlabelled rows and rows whose vector is
    NULL or holds a NULL element are left out. The label test is a Spark filter; the
    feature test runs inside the task, because a filter on a computed vector would be
    pushed below its projection and evaluate the whole expression twice."""
    cols = [F.col(features).cast("array<double>").alias("_x"), F.col(label).cast("int").alias("_y")]
    cols.append((F.col(group).cast("string") if group else F.lit("all")).alias("_g"))
    src = df.filter(F.col(label).isNotNull()).select(*cols)

    def partial(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        slot = (task.partitionId() if task else 0) % MERGE_SLOTS
        acc: dict[str, np.ndarray] = {}
        for b in batches:
            x, ok = _whole_vectors(b.column(0))
            y = b.column(1).to_numpy(zero_copy_only=False)[ok]
            if ((y < 0) | (y >= num_classes)).any():
                raise ValueError(f"label outside 0..{num_classes - 1}")
            z = np.concatenate([x, np.eye(num_classes)[y.astype(np.int64)]], axis=1)
            codes, names = pd.factorize(b.column(2).to_pandas()[ok], use_na_sentinel=False)
            for c, g in enumerate(names):
                rows = codes == c
                m = x[rows].T @ z[rows]
                acc[g] = acc[g] + m if g in acc else m
        for g, m in acc.items():
            d = m.shape[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if g is None else str(g)] * d, pa.string()), pa.array(np.arange(d, dtype=np.int32)),
                 pa.array([slot] * d, pa.int32()), pa.array(list(m), pa.list_(pa.float64()))],
                names=["grp", "i", "slot", "row"])

    summed = src.mapInArrow(partial, GRAM_ROW_SCHEMA).select("grp", "i", "slot", array_to_vector("row").alias("_s"))
    for level in (["grp", "i", "slot"], ["grp", "i"]):
        summed = summed.groupBy(*level).agg(Summarizer.sum(F.col("_s")).alias("_s"))
    return summed.select("grp", "i", vector_to_array(F.col("_s")).alias("row"))


def _whole_vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors without a NULL as a matrix, and the mask of their rows."""
    import pyarrow.compute as pc
    ok = col.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    lens = pc.list_value_length(col).drop_null().to_numpy(zero_copy_only=False)
    if len(set(lens.tolist())) > 1:
        raise ValueError(f"feature vectors of different widths: {sorted(set(lens.tolist()))}")
    flat = col.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lens), lens[0] if len(lens) else 0)
    if flat.null_count:
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(x.shape).any(axis=1)
        x, ok = x[whole], ok.copy()
        ok[np.flatnonzero(ok)[~whole]] = False
    return x, ok


def gram_sums(df: DataFrame, features: str, label: str, num_classes: int,
              group: str | None = None) -> DataFrame:
    """Long form ``(grp, i, j, value)`` of :func:`gram_rows`."""
    return gram_rows(df, features, label, num_classes, group) \
        .select("grp", "i", F.posexplode("row").alias("j", "value"))


def _matrices(rows) -> dict[str, np.ndarray]:
    """Collected :func:`gram_rows` as ``{group: [X^T X | X^T Y]}``."""
    by_group: dict[str, dict[int, list]] = {}
    for r in rows:
        by_group.setdefault(r["grp"], {})[int(r["i"])] = r["row"]
    # a task without a whole vector sends no row, so every group has all d rows
    return {g: np.array([items[i] for i in range(len(items))]) for g, items in by_group.items()}


def _labelled(df: DataFrame, features: str, label: str, num_classes: int, group: str | None) -> DataFrame:
    """Triangles of ``[X | one_hot(label)]``, one a group; like the Gram sums, unlabelled rows and
    vectors that are NULL or hold a NULL are left out."""
    src = df.filter(F.col(label).isNotNull()).select(
        F.col(features).cast("array<double>").alias("_x"), F.col(label).cast("int").alias("_y"),
        (F.col(group).cast("string") if group else F.lit("all")).alias("_g"))

    def blocks(b):
        x, ok = _whole_vectors(b.column(0))
        y = b.column(1).to_numpy(zero_copy_only=False)[ok]
        if ((y < 0) | (y >= num_classes)).any():
            raise ValueError(f"label outside 0..{num_classes - 1}")
        z = np.concatenate([x, np.eye(num_classes)[y.astype(np.int64)]], axis=1)
        names = b.column(2).filter(pa.array(ok)).dictionary_encode("encode")
        codes, names = names.indices.to_numpy(), names.dictionary.to_pylist()
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(names)))
        for g, part in zip(names, np.split(order, ends[:-1])):
            yield g, z[part]

    return tsqr.triangles(src, blocks)


def fit_mapped_heads(df: DataFrame, features: str, label: str, num_classes: int,
                     maps: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Closed-form heads on linear maps of one vector (layer views, fused views), all from
    one ungrouped pass: with ``[X | Y] = Q R`` the features ``M x`` have the triangle
    ``R11 M^T`` against ``R12``, so no row is mapped or repeated. Returns each
    head folded with its map (``W M``): it reads the raw vector."""
    r = tsqr.collected(_labelled(df, features, label, num_classes, None))
    if r is None:
        raise ValueError("no labelled rows to fit")
    d = len(r) - num_classes
    return {name: tsqr.solve(_with_targets(r[:d, :d] @ m.T, r[:d, d:]), num_classes) @ m for name, m in maps.items()}


def _with_targets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return tsqr.fold(None, np.concatenate([x, y], axis=1))


def fit_lstsq_groups(df: DataFrame, features: str, label: str, num_classes: int, group: str) -> DataFrame:
    """Minimum-norm least-squares heads, no intercept, one for each value of ``group``: a table
    ``(grp, class, w)``. Each group is solved on the executor that merged it, so the number of
    groups is bounded by the cluster and not by the driver. A NULL group is a group."""
    return tsqr.solved(_labelled(df, features, label, num_classes, group), num_classes)


def fit_lstsq(df: DataFrame, features: str, label: str, num_classes: int,
              group: str | None = None, max_groups: int = 1000) -> dict[str, np.ndarray] | np.ndarray:
    """Minimum-norm least-squares head(s), no intercept. Returns ``W`` (K x d), or
    ``{group: W}`` of at most ``max_groups`` groups when ``group`` is given; for more use
    :func:`fit_lstsq_groups`."""
    if group:
        rows = fit_lstsq_groups(df, features, label, num_classes, group).limit(max_groups * num_classes + 1).collect()
        if len(rows) > max_groups * num_classes:
            raise ValueError(f"more than {max_groups} groups: use fit_lstsq_groups")
        heads: dict[str, np.ndarray] = {}
        for r in rows:
            heads.setdefault(r["grp"], np.zeros((num_classes, len(r["w"]))))[r["class"]] = r["w"]
        return heads
    r = tsqr.collected(_labelled(df, features, label, num_classes, None))
    if r is None:
        raise ValueError("no labelled rows to fit")
    return tsqr.solve(r, num_classes)


def _lr_input(df: DataFrame, features: str, label: str) -> DataFrame:
    """Labelled rows with a vector; like the closed form, NULL vectors (or elements) are left out."""
    whole = F.col(features).isNotNull() & ~F.exists(F.col(features), lambda v: v.isNull()) & F.col(label).isNotNull()
    return df.filter(whole).select(array_to_vector(F.col(features)).alias("features"),
                                   F.col(label).cast("double").alias("label"))


def _lr(max_iter: int, reg: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", family="multinomial",
                              maxIter=max_iter, regParam=reg, standardization=False)


def fit_softmax_head(df: DataFrame, features: str, label: str, max_iter: int = 100,
                     reg: float = 0.0):
    """Multinomial logistic-regression head on frozen features (Spark ML)."""
    return _lr(max_iter, reg).fit(_lr_input(df, features, label))


def softmax_head_weights(model) -> tuple[np.ndarray, np.ndarray]:
    """``(W, b)`` of a fitted multinomial model, for the JVM scorer."""
    return model.coefficientMatrix.toArray(), model.interceptVector.toArray()


def softmax_gradient(df: DataFrame, features: str, label: str, w: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum over rows of ``(p - y) [x | 1]`` (``K x (d + 1)``) for the head ``w`` with its bias
    as the last column, and the row count: one distributed pass, merged like the Gram sums."""
    k, d1 = w.shape

    def partial(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        total, n = np.zeros((k, d1)), 0
        for b in batches:
            x, ok = _whole_vectors(b.column(0))
            y = b.column(1).to_numpy(zero_copy_only=False)[ok].astype(np.int64)
            if not len(y):
                continue
            if ((y < 0) | (y >= k)).any():
                raise ValueError(f"label outside 0..{k - 1}")
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            z = x @ w.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1.0
            total, n = total + p.T @ x, n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task.partitionId() if task else 0) % MERGE_SLOTS], pa.int32()),
                 pa.array([np.append(total.ravel(), n)], pa.list_(pa.float64()))], names=["slot", "row"])

    src = df.filter(F.col(label).isNotNull()).select(F.col(features).cast("array<double>").alias("_x"),
                                                     F.col(label).cast("int").alias("_y"))
    sums = src.mapInArrow(partial, "slot int, row array<double>").select("slot", array_to_vector("row").alias("_s"))
    sums = sums.groupBy("slot").agg(Summarizer.sum(F.col("_s")).alias("_s")).agg(Summarizer.sum(F.col("_s")).alias("_s"))
    row = sums.select(vector_to_array("_s").alias("row")).collect()[0]["row"]
    if not row:
        return np.zeros((k, d1)), 0
    return np.array(row[:-1]).reshape(k, d1), int(row[-1])


def fit_rounds(df: DataFrame, features: str, label: str, num_classes: int, steps: Sequence[int],
               reg: float = 1e-3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Fit rounds that continue: round ``r`` takes ``steps[r]`` more steps from the weights
    that the round before left. Returns ``(W, b)`` after each round.

    A step is one distributed gradient of the mean cross-entropy (plus ``reg / 2`` times the
    squared weights), divided by a fixed bound of its curvature, half the Gram matrix of
    ``[x | 1]`` over n: the loss falls with every step, whatever the start, and no
    step size is tuned. The Gram matrix is one more pass before the first round."""
    ones = df.withColumn("_x1", F.concat(F.col(features).cast("array<double>"), F.array(F.lit(1.0))))
    found = _matrices(gram_rows(ones, "_x1", label, num_classes).collect())
    if not found:
        raise ValueError("no labelled rows to fit")
    g = found["all"][:, :-num_classes]
    bound = np.linalg.pinv(0.5 * g / g[-1, -1] + reg * np.eye(len(g)), hermitian=True)
    w, rounds = np.zeros((num_classes, len(g))), []
    for count in steps:
        for _ in range(count):
            grad, n = softmax_gradient(df, features, label, w)
            w = w - (grad / n + reg * w) @ bound
        rounds.append((w[:, :-1].copy(), w[:, -1].copy()))
    return rounds

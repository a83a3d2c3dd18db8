"""Tall-skinny QR: the triangle ``R`` of ``X = QR`` without the square of ``X``.

Every task reduces its batches to one ``d x d`` triangle a group, triangles meet in a
tree of slots, and only triangles are shuffled. ``R`` has the singular values of ``X``, so
what is solved from it has the condition of ``X`` and not its square, as a Gram matrix has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRIANGLES = T.StructType([
    T.StructField("grp", T.StringType()),
    T.StructField("slot", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("r", T.ArrayType(T.DoubleType())),
])

# Slots of each level: 400k tasks give about 800 triangles a slot, then 32, then 16.
SLOTS = (512, 16, 1)

Blocks = Callable[[pa.RecordBatch], Iterator[tuple[str | None, np.ndarray]]]


def fold(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The square triangle of ``r`` and ``rows`` together."""
    width = rows.shape[1]
    if r is not None and r.shape[1] != width:
        raise ValueError(f"rows of different widths: {r.shape[1]} and {width}")
    out = np.zeros((width, width))
    found = np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")
    out[:len(found)] = found
    return out


def _batch(rows: list[tuple[str | None, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([g for g, _, _ in rows], pa.string()), pa.array([s for _, s, _ in rows], pa.int32()),
         pa.array([len(r) for _, _, r in rows], pa.int32()), pa.array([r.ravel() for _, _, r in rows], pa.list_(pa.float64()))],
        names=TRIANGLES.names)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, np.ndarray]]:
    for b in batches:
        for k in range(b.num_rows):
            width = b.column(2)[k].as_py()
            yield b.column(0)[k].as_py(), b.column(1)[k].as_py(), np.array(b.column(3)[k].values).reshape(width, width)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, np.ndarray]]:
    """One triangle for each run of equal (grp, slot); rows come sorted by them."""
    now, r = None, None
    for g, s, more in _each(batches):
        if r is not None and now != (g, s):
            yield *now, r
            r = None
        now, r = (g, s), fold(r, more)
    if r is not None:
        yield *now, r


def triangles(df: DataFrame, blocks: Blocks) -> DataFrame:
    """``TRIANGLES``, one row a group, of the rows that ``blocks`` makes of each Arrow batch of
    ``df``: pairs of group name and float64 matrix.

    A task holds one triangle for each group that it meets. A group without rows gives none,
    fewer rows than columns give a triangle with zero rows at its end.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get()
        acc: dict[str | None, np.ndarray] = {}
        for b in batches:
            for g, rows in blocks(b):
                if len(rows):
                    acc[g] = fold(acc.get(g), rows)
        for g, r in acc.items():
            yield _batch([(g, task.partitionId() if task else 0, r)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _merged(batches):
            yield _batch([found])

    out = df.mapInArrow(partial, TRIANGLES)
    for slots in SLOTS:
        out = (out.withColumn("slot", out.slot % slots).repartition("grp", "slot").sortWithinPartitions("grp", "slot")
               .mapInArrow(merge, TRIANGLES))
    return out


def solve(r: np.ndarray, targets: int) -> np.ndarray:
    """Minimum-norm least squares from the triangle of ``[X | Y]``: ``W`` with a row a target.
    Singular values below 16 widths of rounding count as zero."""
    d = len(r) - targets
    return (np.linalg.pinv(r[:d, :d], rcond=16 * len(r) * np.finfo(float).eps) @ r[:d, d:]).T


def solved(found: DataFrame, targets: int) -> DataFrame:
    """``(grp, class, w)``: the head of every group of :func:`triangles`, solved where its
    triangle lies; nothing reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _, r in _each(batches):
            w = solve(r, targets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * targets, pa.string()), pa.array(np.arange(targets, dtype=np.int32)),
                 pa.array(list(w), pa.list_(pa.float64()))], names=["grp", "class", "w"])

    return found.mapInArrow(run, "grp string, class int, w array<double>")


def collected(found: DataFrame) -> np.ndarray | None:
    """The triangle of an ungrouped fit (parameter-sized); None without rows."""
    rows = found.take(2)
    if len(rows) > 1:
        raise ValueError("the fit has groups: use solved()")
    return np.array(rows[0]["r"]).reshape(rows[0]["width"], rows[0]["width"]) if rows else None

"""Array maths on ``ARRAY<DOUBLE|FLOAT>`` columns.

Vectors are Spark arrays; matrices are arrays of row arrays. Weight matrices are
parameters (classes x width), never data, so they enter the plan as literals and
are constant-folded by Catalyst. Per-row work uses the higher-order functions
``transform`` / ``zip_with`` / ``aggregate``, which run in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def array_literal(values: Sequence[float]) -> Column:
    """A literal ``ARRAY<DOUBLE>``."""
    return F.array(*[F.lit(float(v)) for v in values])


def matrix_literal(rows: Sequence[Sequence[float]]) -> Column:
    """A literal ``ARRAY<ARRAY<DOUBLE>>`` (one inner array per output row)."""
    return F.array(*[array_literal(r) for r in rows])


def matvec(x, weights, bias=None) -> Column:
    """``W x + b``: one output per row of ``weights``.

    ``weights`` is a nested list (literal) or an ``ARRAY<ARRAY<DOUBLE>>`` column,
    which lets the matrix vary per row (e.g. one head per round).
    """
    x = _c(x)
    wcol = matrix_literal(weights) if isinstance(weights, (list, tuple)) else _c(weights)
    out = F.transform(wcol, lambda row: F.aggregate(
        F.zip_with(x, row, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v))
    if bias is not None:
        bcol = array_literal(bias) if isinstance(bias, (list, tuple)) else _c(bias)
        out = F.zip_with(out, bcol, lambda a, b: a + b)
    # a NULL vector gives NULL (not an array of NULLs)
    return F.when(x.isNotNull(), out)


def argmax(logits) -> Column:
    """0-based index of the first maximum (ties go to the lowest index)."""
    l = _c(logits)
    return (F.array_position(l, F.array_max(l)) - 1).cast("int")


def has_nan(logits) -> Column:
    return F.exists(_c(logits), lambda v: F.isnan(v))


def vec_add(a, b) -> Column:
    """Element-wise sum (``zip_with``). Widths are not checked here, so the inputs
    are referenced once each; :func:`vec_sum` checks them on its inputs."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))


def same_width(*cols) -> Column:
    """True when all arrays have the width of the first one."""
    cs = [_c(c) for c in cols]
    return reduce(lambda acc, c: acc & (F.size(c) == F.size(cs[0])), cs[1:], F.lit(True))


def vec_sum(*cols) -> Column:
    """Element-wise sum of several arrays; raises when their widths differ.
    Pass column names (or cheap columns): each input is referenced twice, once
    for the width check."""
    cs = [_c(c) for c in cols]
    total = reduce(vec_add, cs)
    if len(cs) < 2:
        return total
    any_null = reduce(lambda a, b: a | b, [c.isNull() for c in cs])
    return F.when(any_null, F.lit(None)).when(same_width(*cs), total).otherwise(
        F.raise_error(F.lit("vec_sum: arrays differ in width")))


def one_hot(label, num_classes: int) -> Column:
    """``ARRAY<DOUBLE>`` of width ``num_classes`` with 1.0 at ``label``."""
    lab = _c(label)
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)),
                       lambda c: F.when(c == lab, F.lit(1.0)).otherwise(F.lit(0.0)))

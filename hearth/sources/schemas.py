"""Declared schemas. Reads fail fast on a mismatch instead of silently
producing NULL columns (a user schema that names a missing column does that)."""

from __future__ import annotations

from pyspark.sql import types as T

# Labelled sentence table as the classification scripts use it.
SENTENCES = T.StructType([
    T.StructField("sentence", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("idx", T.LongType()),
])

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("quality", T.IntegerType()),
    T.StructField("toxic", T.IntegerType()),
])

EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# Head weights as a table: one row per class.
HEAD = T.StructType([
    T.StructField("class_id", T.IntegerType()),
    T.StructField("w", T.ArrayType(T.DoubleType())),
    T.StructField("b", T.DoubleType()),
])

SCHEMAS = {
    "sentences": SENTENCES,
    "documents": DOCUMENTS,
    "labels": LABELS,
    "embeddings": EMBEDDINGS,
    "conversations": CONVERSATIONS,
    "pages": PAGES,
    "head": HEAD,
}


def _strip_nullability(dt: T.DataType) -> T.DataType:
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_strip_nullability(dt.elementType))
    if isinstance(dt, T.MapType):
        return T.MapType(_strip_nullability(dt.keyType), _strip_nullability(dt.valueType))
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _strip_nullability(f.dataType))
                             for f in dt.fields])
    return dt


def check_schema(found: T.StructType, expected: T.StructType, what: str = "table") -> None:
    """Raise ``ValueError`` unless every expected column exists with the same type.
    Extra columns are allowed (they are pruned by the projection anyway)."""
    have = {f.name: _strip_nullability(f.dataType) for f in found.fields}
    problems = []
    for f in expected.fields:
        if f.name not in have:
            problems.append(f"missing column {f.name!r}")
        elif have[f.name] != _strip_nullability(f.dataType):
            problems.append(f"column {f.name!r} is {have[f.name].simpleString()}, "
                            f"expected {f.dataType.simpleString()}")
    if problems:
        raise ValueError(f"{what}: " + "; ".join(problems))

"""Flagging rows by literal substrings or name targets, and reporting which
patterns matched nothing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.text import any_contains, matches_target


def flag_any(df: DataFrame, col: str, patterns: Sequence[str], out: str = "flag") -> DataFrame:
    """``flag = any pattern is a substring``; every other row is reset to False."""
    return df.withColumn(out, any_contains(col, patterns))


def flag_additive(df: DataFrame, col: str, patterns: Sequence[str], flag: str = "flag") -> DataFrame:
    """Rows already flagged stay flagged; matching rows are added."""
    return df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | any_contains(col, patterns))


def flag_inverse(df: DataFrame, col: str, patterns: Sequence[str], out: str = "flag") -> DataFrame:
    """True unless some pattern matches."""
    return df.withColumn(out, ~any_contains(col, patterns))


def list_flagged(df: DataFrame, key: str, flag: str = "flag") -> DataFrame:
    return df.filter(F.col(flag)).select(key)


def flag_targets(df: DataFrame, col: str, targets: Sequence[str], out: str = "flag") -> DataFrame:
    """Name matches a target exactly or ends with ``'.' + target``."""
    return df.withColumn(out, matches_target(col, targets))


def pattern_report(df: DataFrame, col: str, patterns: Sequence[str],
                   mode: str = "contains") -> DataFrame:
    """``(pattern, n_matched)`` for every pattern, zero matches included, in one
    scan (one conditional count per pattern, partially aggregated)."""
    test = any_contains if mode == "contains" else matches_target
    counts = df.agg(*[F.count(F.when(test(col, [p]), 1)).alias(f"_p{i}")
                      for i, p in enumerate(patterns)])
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"_p{i}").alias("n_matched"))
                     for i, p in enumerate(patterns)])
    return counts.select(F.inline(rows))


# ------------------------------------------------------------------ thousands of patterns

# Bytes of all patterns together that every task may hold as an automaton.
PATTERNS_MAX_BYTES = 64 * 1024 * 1024


def contained(col: str, patterns: Sequence[str]) -> Column:
    """``ARRAY<INT>``: the places in ``patterns`` of all that the value contains, rising. Literal,
    case-sensitive and unanchored like :func:`flag_any`; NULL contains nothing.

    One automaton of all patterns reads each value once, whatever their number, where a chain
    of ``contains`` reads it once for each and makes a plan of that width.
    """
    size = sum(len(p.encode()) for p in patterns)
    if size > PATTERNS_MAX_BYTES:
        raise ValueError(f"{size} bytes of patterns; an automaton holds {PATTERNS_MAX_BYTES}")
    places: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        places.setdefault(p, []).append(i)
    every = places.pop("", [])  # the empty pattern is in every value

    @F.arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for p, at in places.items():
            automaton.add_word(p, at)
        automaton.make_automaton()
        for values in batches:
            out = []
            for v in values.to_pylist():
                hit = {tuple(at) for _, at in automaton.iter(v)} if v and places else ()
                out.append([] if v is None else sorted([*every, *(i for at in hit for i in at)]))
            yield pa.array(out, pa.list_(pa.int32()))

    return find(F.col(col))


def flag_any_many(df: DataFrame, col: str, patterns: Sequence[str], out: str = "flag") -> DataFrame:
    """:func:`flag_any` for any number of patterns."""
    return df.withColumn(out, F.size(contained(col, patterns)) > 0)


def pattern_report_many(df: DataFrame, col: str, patterns: Sequence[str]) -> DataFrame:
    """:func:`pattern_report` for any number of patterns: ``(pattern, n_matched)``, zero matches
    included, in one scan. Counts are partially aggregated; a task sends a row a pattern at most."""
    hits = df.select(F.explode(contained(col, patterns)).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    listed = df.sparkSession.createDataFrame(list(enumerate(patterns)), "at int, pattern string")
    return listed.join(hits, F.col("at") == F.col("i"), "left").select("pattern", F.coalesce("n", F.lit(0)).alias("n_matched"))


def _suffixes(col: Column) -> Column:
    """The value and what follows each of its dots."""
    parts = F.split(col, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def match_targets(df: DataFrame, key: str, col: str, targets: DataFrame | Sequence[str]) -> DataFrame:
    """``(key, target)`` for every target that the name equals or ends with after a dot, as in
    :func:`flag_targets`. ``targets``: a list, or a table with a column ``target`` of any size.

    A name has as many suffixes as dots and one, so one equi-join takes the place of a test
    for each target; a hot suffix is a skewed key of a join, which AQE splits.
    """
    if not isinstance(targets, DataFrame):
        targets = df.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    names = df.where(F.col(col).isNotNull()).select(key, F.explode(_suffixes(F.col(col))).alias("_suffix"))
    wanted = targets.where(F.col("target").isNotNull()).select("target").distinct()
    return names.join(wanted, F.col("_suffix") == F.col("target")).select(key, "target")


def target_report_many(df: DataFrame, key: str, col: str, targets: DataFrame | Sequence[str]) -> DataFrame:
    """``(pattern, n_matched)`` for every target, zero matches included."""
    if not isinstance(targets, DataFrame):
        targets = df.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    n = match_targets(df, key, col, targets).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return targets.select(F.col("target").alias("pattern")).distinct().join(n, F.col("pattern") == F.col("target"), "left") \
        .select("pattern", F.coalesce("n", F.lit(0)).alias("n_matched"))

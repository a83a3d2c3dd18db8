"""Quality rules: fixed base rules, then robust multivariate outliers.

Each text's statistics become a transformed vector; for each language and source a
minimum-covariance-determinant (MCD) estimate gives centre and scatter, and a vector
whose robust Mahalanobis distance exceeds the cut is rejected.

The MCD runs as concentration steps over the table of vectors, from several starts at
once. Each step bins the squared distances, sums first and second moments by group, start
and bin with map-side combine (a hot group costs one row per bin and task), takes the bins
that hold the nearest share ``CORE`` of the group, and re-estimates from them. Of each
group the start that ended at the least determinant counts. Medians come from counts by
fixed bins, which any number of tasks adds up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.common import Scratch

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CORE = 0.75  # share of a group in the determinant's subset
STEPS = 4
# Starts of the concentration steps: medians and median deviations, means and covariance of all
# rows, and the nearest half by medians.
STARTS = 3
MIN_GROUP = 100  # smaller groups take the estimate of their language, then of all rows
# Rejection: a squared distance that one normal vector in 10^9 passes. Statistics of clean text
# have heavier tails than that: at 10^-3 some 0.2 % of documents labelled clean would go.
TAIL = 1e-9
# Smallest scale of each transformed feature: a group whose documents agree exactly
# still lets documents differ by a few of these.
FLOOR = (0.5, 0.1, 0.1, 0.25, 0.25)
BINS = 64
FINE = 100  # bins a unit, for medians

_SYMBOLS = re.compile(r"[#*$%&|<>]")


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    white = sum(map(text.count, " \t\n\v\f\r"))
    lines: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            dup += line in lines
            lines.add(line)
    return n, len(text) - white, len(_SYMBOLS.findall(text)), dup, _repeat_words(words)


def _repeat_words(words: list[bytes], size: int = 5) -> int:
    n = len(words)
    if n <= size:
        return 0
    shifted = [words[k:] for k in range(size)]
    if len(set(zip(*shifted))) == n - size + 1:
        return 0
    count = Counter(zip(*shifted))
    hit = np.zeros(n + 1, np.int64)
    for i, w in enumerate(zip(*shifted)):
        if count[w] > 1:
            hit[i] += 1
            hit[i + size] -= 1
    return int((np.cumsum(hit)[:n] > 0).sum())


def add_stats(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` plus the five statistics (long) of every row's whole text."""
    src = df.select(*keep, F.col(text).alias("_text"))
    names = src.columns[:-1]
    schema = T.StructType([*src.schema.fields[:-1], *(T.StructField(s, T.LongType()) for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([text_stats(t) for t in b.column(len(names)).to_pylist()], np.int64).reshape(-1, 5)
            cols = [b.column(i) for i in range(len(names))] + [pa.array(stats[:, k]) for k in range(5)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *STATS])

    return src.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> list[Column]:
    """Transformed statistics: length, mean word length, and shares of symbols, repeated
    lines and repeated words on a logarithmic scale."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.log1p(F.col(c) / n * 10)
    return [F.log1p("n_words"), F.log1p(F.col("word_chars") / n), share("n_symbols"), share("n_dup_lines"),
            share("n_repeat_words")]


P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _moments(x: Column) -> list[Column]:
    xs = [F.get(x, F.lit(i)) for i in range(P)]
    return ([F.count("*").alias("n")] + [F.sum(xs[i]).alias(f"s{i}") for i in range(P)]
            + [F.sum(xs[i] * xs[j]).alias(f"q{i}_{j}") for i, j in PAIRS])


def _distance(x: Column) -> Column:
    """Squared Mahalanobis distance of ``x`` from (mu, inv) of the joined estimate."""
    d = [F.get(x, F.lit(i)) - F.get("mu", F.lit(i)) for i in range(P)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + (1 if i == j else 2) * F.get("inv", F.lit(k)) * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _estimate(share: float):
    """A function from the moments by bin of one group and start to its centre, inverse
    scatter and determinant. ``share`` may be less in a start's first step."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bin")
        near = share * float(g["part"].iloc[0])
        upto = int(np.searchsorted(np.cumsum(g["n"].to_numpy()), near * g["n"].sum() - 1e-9)) + 1
        core = g.iloc[:upto]
        n = float(core["n"].sum())
        mu = np.array([core[f"s{i}"].sum() / n for i in range(P)])
        cov = np.zeros((P, P))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = core[f"q{i}_{j}"].sum() / n - mu[i] * mu[j]
        inv, det = _scatter(cov, n / float(g["n"].sum()))
        return pd.DataFrame({"level": [g["level"].iloc[0]], "lang": [g["lang"].iloc[0]], "source": [g["source"].iloc[0]],
                             "start": [int(g["start"].iloc[0])], "total": [int(g["n"].sum())], "mu": [mu.tolist()],
                             "inv": [[inv[i, j] for i, j in PAIRS]], "det": [det], "part": [1.0]})

    return run


def _scatter(cov: np.ndarray, kept: float) -> tuple[np.ndarray, float]:
    """Inverse and determinant of the scatter of the nearest ``kept``: made consistent, each
    feature's scale raised to its floor, correlations as they are."""
    if kept < 0.999:
        cov = cov * _consistency(kept)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    cov = cov + np.diag(np.maximum(np.array(FLOOR) ** 2 - sd ** 2, 0)) + np.diag(np.full(P, 1e-9))
    return np.linalg.pinv(cov, hermitian=True), float(np.linalg.det(cov))


def _chi2(q: float, p: int) -> float:
    """P(chi-square <= q) with an odd number p of degrees."""
    from math import erf, exp, pi, sqrt
    total, term = erf(sqrt(q / 2)), sqrt(2 * q / pi) * exp(-q / 2)
    for k in range(1, p, 2):
        total -= term
        term *= q / (k + 2)
    return total


def _chi2_quantile(share: float, p: int = P) -> float:
    lo, hi = 1e-6, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, p) < share else (lo, mid)
    return lo


def _consistency(share: float) -> float:
    """Factor that makes the scatter of the nearest ``share`` of a normal sample consistent:
    share / P(chi2(p + 2) <= q) with q the share's quantile of chi2(p), p = 5."""
    return share / max(_chi2(_chi2_quantile(share), P + 2), 1e-9)


def cut(total: Column) -> Column:
    """The largest squared distance that is kept: a quantile of chi-square, larger where the
    estimate stands on few rows and varies itself."""
    return F.lit(_chi2_quantile(1 - TAIL)) * F.greatest(F.lit(1.0), total / F.greatest(total - P - 2, F.lit(1)))


EST = ("level int, lang string, source string, start int, total long, mu array<double>, inv array<double>, det double, part double")
KEYS = ["level", "lang", "source"]


def _medians(rows: DataFrame, x: Column, schema: str) -> DataFrame:
    """Medians of the entries of ``x`` by group, from counts in bins of ``1 / FINE``."""
    bins = rows.select(*KEYS, F.posexplode(x).alias("i", "v")).groupBy(*KEYS, "i", F.floor(F.col("v") * FINE).cast("int").alias("bin"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = []
        for i in range(P):
            part = g[g["i"] == i].sort_values("bin")
            upto = np.cumsum(part["n"].to_numpy())
            m.append((float(part["bin"].iloc[int(np.searchsorted(upto, upto[-1] / 2))]) + 0.5) / FINE)
        return pd.DataFrame({c: [g[c].iloc[0]] for c in KEYS} | {"mu": [m]})

    return bins.agg(F.count("*").alias("n")).groupBy(*KEYS).applyInPandas(run, schema)


def mcd(rows: DataFrame, scratch: Scratch, share: float = CORE, steps: int = STEPS) -> DataFrame:
    """The estimate of each group of ``rows (level, lang, source, x)``: total, mu, inv, det."""
    schema = "level int, lang string, source string, mu array<double>"
    med = scratch.save(_medians(rows, F.col("x"), schema), "medians")
    apart = F.zip_with("x", "mu", lambda a, b: F.abs(a - b))
    dev = scratch.save(_medians(_with(rows, med), apart, schema).withColumnRenamed("mu", "dev"), "deviations")
    scale = [1 / F.pow(F.greatest(1.4826 * F.get("dev", F.lit(i)), F.lit(FLOOR[i])), F.lit(2)) for i in range(P)]
    inv = F.array(*[scale[i] if i == j else F.lit(0.0) for i, j in PAIRS])
    by_median = _with(dev, med).select(*KEYS, "mu", inv.alias("inv"))
    # from all rows: one step whose share is the whole
    whole = rows.select(*KEYS, "x", F.lit(1).alias("start"), F.lit(0).alias("bin"), F.lit(1.0).alias("part"))
    by_mean = whole.groupBy(*KEYS, "start", "bin", "part").agg(*_moments(F.col("x"))).groupBy(*KEYS).applyInPandas(_estimate(1.0), EST)
    est = by_median.select("*", F.lit(0).alias("start"), F.lit(1.0).alias("part"))
    est = est.unionByName(by_median.select("*", F.lit(2).alias("start"), F.lit(0.5 / share).alias("part")))
    est = scratch.save(est.unionByName(by_mean.select(*KEYS, "mu", "inv", "start", "part")), "start")
    for k in range(steps):
        d = _distance(F.col("x"))
        # fine bins near the centre: the subset's edge is met within a few per cent
        bin_ = F.least(F.floor(F.log1p(d) * (BINS / 8)), F.lit(BINS - 1)).cast("int")
        sums = _with(rows, est).groupBy(*KEYS, "start", "part", bin_.alias("bin")).agg(*_moments(F.col("x")))
        est = scratch.save(sums.groupBy(*KEYS, "start").applyInPandas(_estimate(share), EST), f"step{k}")
    best = est.groupBy(*KEYS).agg(F.min(F.struct("det", "start", "total", "mu", "inv")).alias("e"))
    return best.select(*KEYS, "e.total", "e.mu", "e.inv", "e.det")


def levels(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """``(level, lang, source, x)`` of the groups that are estimated: at level 0 languages and
    sources of ``MIN_GROUP`` rows or more; at level 1, source null, the large languages that
    have a smaller group; at level 2 all rows, if a language is small."""
    groups = scratch.save(vectors.groupBy("lang", "source").agg(F.count("*").alias("n")), "groups")
    langs = scratch.save(groups.groupBy("lang").agg(F.sum("n").alias("n"), F.min("n").alias("least")), "langs")
    null = F.lit(None).cast("string")
    g = groups.where(F.col("n") >= MIN_GROUP).select(F.col("lang").alias("l"), F.col("source").alias("s"))
    out = vectors.join(g, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left_semi").select(
        F.lit(0).alias("level"), "lang", "source", "x")
    some = langs.where((F.col("least") < MIN_GROUP) & (F.col("n") >= MIN_GROUP)).select(F.col("lang").alias("l"))
    out = out.unionByName(vectors.join(some, F.col("lang").eqNullSafe(F.col("l")), "left_semi").select(
        F.lit(1).alias("level"), "lang", null.alias("source"), "x"))
    if langs.where(F.col("n") < MIN_GROUP).head(1):
        out = out.unionByName(vectors.select(F.lit(2).alias("level"), null.alias("lang"), null.alias("source"), "x"))
    return out


def _with(rows: DataFrame, est: DataFrame) -> DataFrame:
    e = est.select(*[F.col(c).alias(f"e_{c}") if c in ("level", "lang", "source") else F.col(c) for c in est.columns])
    return rows.join(e, (F.col("level") == F.col("e_level")) & F.col("lang").eqNullSafe(F.col("e_lang"))
                     & F.col("source").eqNullSafe(F.col("e_source"))).drop("e_level", "e_lang", "e_source")


def judge(df: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", lang: str = "lang",
          source: str = "source", carry: bool = False) -> DataFrame:
    """``key``, the five statistics, base_failed, distance and kept for every row (and
    ``row``, the whole input row as a struct, with ``carry``).

    A null text has no words and fails the base rules. Rows that fail them are no part
    of the estimates. Null languages and sources are groups of their own; a group of
    fewer than ``MIN_GROUP`` rows is judged by its language, a small language by all
    rows, however few those are: the floors are then the scale and :func:`cut` is wider.
    Texts of any length are read whole; an empty table gives no rows.
    """
    keep = [F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source")]
    if carry:
        keep.append(F.struct("*").alias("row"))
    stats = add_stats(df, text, keep).withColumn("base_failed", base_failed())
    stats = scratch.save(stats.withColumn("x", F.array(*features())), "stats")
    rows = scratch.save(levels(stats.where("NOT base_failed").select("lang", "source", "x"), scratch), "vectors")
    est = mcd(rows, scratch)
    out = stats
    for level, on in ((0, ("lang", "source")), (1, ("lang",)), (2, ())):
        e = est.where(F.col("level") == level).select(
            *[F.col(c).alias(f"e_{c}") for c in on], F.struct("mu", "inv", "total").alias(f"e{level}"))
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"e_{c}"))
        if not on:
            e = F.broadcast(e)  # one row
        out = out.join(e, cond, "left").drop(*[f"e_{c}" for c in on])
    out = out.withColumn("e", F.coalesce("e0", "e1", "e2")).withColumn("mu", F.col("e.mu")).withColumn("inv", F.col("e.inv"))
    out = out.withColumn("distance", _distance(F.col("x")))
    kept = ~F.col("base_failed") & (F.col("distance") <= cut(F.col("e.total")))
    kept = F.coalesce(kept, F.lit(False))  # no estimate: no row passed the base rules
    return out.select(F.col("key").alias(key), *STATS, "base_failed", "distance", kept.alias("kept"),
                      *(["row"] if carry else []))

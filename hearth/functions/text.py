"""String helpers: tokenisation, literal stripping, substring flags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace tokenisation: lower-case, split on runs of whitespace, drop empties.
TOKEN_SPLIT = r"\s+"

# URL key recipe (fixed values): literal prefixes removed in this order, all
# occurrences, before taking the part ahead of the first '/'.
URL_STRIP = ["https://", "http://", "www."]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text) -> Column:
    """``ARRAY<STRING>`` of lower-cased whitespace-separated tokens (no empties:
    leading / trailing whitespace and blank text split into ``''``, removed with
    the code-generated ``array_remove`` rather than an interpreted lambda)."""
    return F.array_remove(F.split(F.lower(_c(text)), TOKEN_SPLIT), "")


def strip_literals(col, literals: Sequence[str]) -> Column:
    """Remove each literal substring (all occurrences), one after another."""
    return reduce(lambda acc, s: F.replace(acc, F.lit(s), F.lit("")), literals, _c(col))


def url_key(url) -> Column:
    """Scheme and ``www.`` removed, then everything from the first '/' dropped."""
    return F.substring_index(strip_literals(url, URL_STRIP), "/", 1)


def any_contains(col, patterns: Sequence[str]) -> Column:
    """True when the value contains any pattern: literal, case-sensitive,
    unanchored (``'classifier'`` matches ``'pre_classifier'``). NULL -> False."""
    c = _c(col)
    if not patterns:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(p) for p in patterns]),
                      F.lit(False))


def matches_target(col, targets: Sequence[str]) -> Column:
    """Module-name matching: the full name equals a target or ends with
    ``'.' + target``."""
    c = _c(col)
    if not targets:
        return F.lit(False)
    conds = [c.isin(list(targets))] + [c.endswith("." + t) for t in targets]
    return F.coalesce(reduce(lambda a, b: a | b, conds), F.lit(False))

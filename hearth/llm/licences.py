"""Licence scan (native DataFrame operations only): phrase places and an exact
set-similarity join of word windows with licence notices.

A window is a run of a document's words, across line ends, ``SLACK`` times as long as
the template. A document meets a template when the distinct words of some window hold at
least ``THRESHOLD`` of the template's. Windows are looked for in blocks of ``STRIDE``
starts, which overlap so that each window lies whole in the block of its start.
The join is exact: template words are ordered by how many documents hold them, rarest
first; a block with a window that meets a template shares one of the template's first
``size - need + 1`` words (prefix filter), has ``need`` template words (length filter),
and has enough left after the shared word in both orders (positional filter).
Survivors are verified window by window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WORDS = f"[{CHARS}]+"
THRESHOLD = 0.9
SLACK = 1.25  # words of a window for each word of the template
STRIDE = 64  # window starts in a block

# Phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices that publishers of each licence ask for, and their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
            "gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def span(template: str) -> int:
    """Words of a window for the template."""
    return math.ceil(SLACK * len(template.split()) - 1e-9)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _whole_words(pattern: str) -> str:
    return f"(?i)(?<![{CHARS}])(?:{pattern})(?![{CHARS}])"


def _places(words: Column, phrase: str) -> Column:
    """Start indexes of ``phrase`` in an array of words."""
    parts = phrase.split()

    def start(w: Column, i: Column) -> Column:
        hit = w == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(hit, i.cast("long"))

    return F.filter(F.transform(words, start), lambda x: x.isNotNull())


def phrase_places(text: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """``struct(n, first, last, labels)`` of the phrases' places; null where there is none.

    Only texts that a plain search finds a phrase in are cut into words."""
    gap = f"[^{CHARS}]+"
    found = text.rlike(_whole_words("|".join(gap.join(p.split()) for p in phrases)))
    words = F.regexp_extract_all(_ascii_lower(text), F.lit(WORDS), F.lit(0))

    def of(ws: Column) -> Column:
        at = [_places(ws, p) for p in phrases]
        every = F.concat(*at)
        labels = F.filter(F.array(*[F.when(F.size(a) > 0, F.lit(x)) for a, x in zip(at, phrases.values())]),
                          lambda x: x.isNotNull())
        return F.struct(F.size(every).cast("long").alias("n"), F.array_min(every).alias("first"),
                        F.array_max(every).alias("last"), labels.alias("labels"))

    # transform over one array of words: the words are made once and named
    return F.when(found, F.transform(F.array(words), of)[0])


def word_frequencies(df: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each word of the vocabulary, over all documents: one row a word of
    the templates comes back. It only orders the words, so that prefixes are rare; every order
    finds the same matches."""
    words = F.regexp_extract_all(_ascii_lower(F.col(text)), F.lit(WORDS), F.lit(0))
    known = df.select(F.explode(F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary]))).alias("word"))
    return {r["word"]: r["n"] for r in known.groupBy("word").agg(F.count("*").alias("n")).collect()}


def template_matches(df: DataFrame, text: str, keys: list[str], templates=TEMPLATES,
                     threshold: float = THRESHOLD) -> DataFrame:
    """``keys``, label, overlap of the best window and size of every pair of a block and a
    template that meets the threshold; ``keys`` are column names of ``df``."""
    spark = df.sparkSession
    sets = [(x, sorted(set(t.split())), span(t)) for x, t in templates]
    vocabulary = sorted({w for _, ws, _ in sets for w in ws})
    n = word_frequencies(df, text, vocabulary)
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}
    prefix = []
    for label, ws, wide in sets:
        need = math.ceil(threshold * len(ws) - 1e-9)
        ws = sorted(ws, key=order.get)
        prefix += [(ws[i], label, i, len(ws), need, wide, ws) for i in range(len(ws) - need + 1)]
    probes = spark.createDataFrame(
        prefix, "probe string, label string, i int, size int, need int, wide int, words array<string>")

    # Blocks with a prefix word: only texts that a search for these words finds are cut into words.
    rare = sorted({p[0] for p in prefix})
    held = F.array(*[F.lit(w) for w in rare])
    longest = STRIDE + max(wide for _, _, wide in sets) - 1

    def cut(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(STRIDE))
        return F.filter(F.transform(starts, lambda s: F.slice(ws, s + 1, longest)), lambda b: F.arrays_overlap(b, held))

    ws = F.regexp_extract_all(_ascii_lower(F.col(text)), F.lit(WORDS), F.lit(0))
    blocks = df.where(F.col(text).rlike(_whole_words("|".join(rare)))).select(
        *keys, F.explode(F.transform(F.array(ws), cut)[0]).alias("block"))
    ranks = F.create_map(*[F.lit(x) for w in sorted(order, key=order.get) for x in (w, order[w])])
    known = F.array_intersect("block", F.array(*[F.lit(w) for w in vocabulary]))
    ordered = F.transform(F.array_sort(F.transform(known, lambda w: F.struct(ranks[w].alias("r"), w.alias("w")))),
                          lambda s: s["w"])
    blocks = blocks.select(*keys, "block", ordered.alias("have"))
    shared = F.filter(F.transform("have", lambda w, j: F.struct(j.alias("j"), w.alias("probe"))),
                      lambda s: F.array_contains(held, s["probe"]))
    pairs = (blocks.select(*keys, "block", "have", F.inline(shared))
             .join(F.broadcast(probes), "probe")  # bounded by the templates
             .where((F.size("have") >= F.col("need"))
                    & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("have") - F.col("j") - 1) >= F.col("need"))))
    pairs = pairs.where(F.size(F.array_intersect("have", "words")) >= F.col("need"))
    # a window that meets a template still does when it starts at the first template word in it
    overlap = F.array_max(F.transform(F.slice("block", 1, STRIDE), lambda w, i: F.when(
        F.array_contains("words", w), F.size(F.array_intersect(F.slice("block", i + 1, F.col("wide")), F.col("words"))))))
    return pairs.select(*keys, "label", overlap.alias("overlap"), "size", "need").where(
        F.col("overlap") >= F.col("need")).drop("need")


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    ``score`` is the best containment found: 1 where a phrase stands, else that of the
    best template, else 0. A null text is empty; empty texts have no words and no
    labels (empty strings); repeated rows each give their row; an empty table none.
    """
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    found = template_matches(docs, "text", ["key", "hash"]).groupBy(
        F.col("key").alias("k"), F.col("hash").alias("h")).agg(
        F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("size")).alias("best"))
    base = docs.select("key", "hash", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("n_words"),
                       phrase_places(F.col("text")).alias("base"))
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.col("base.labels"), none)
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.coalesce("more", none))))
    return base.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("base.n", F.lit(0)).alias("n_base"),
        F.col("base.first").alias("first_word"), F.col("base.last").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("base.n") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))

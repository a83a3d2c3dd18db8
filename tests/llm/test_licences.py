import math
import random
import re

import duckdb
from pyspark.sql import functions as F

from hearth.llm import licences
from hearth.llm.oracles import op6
from hearth.llm.queries import op6_licences

from .conftest import fixture

LOW = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    text = (text or "").translate(LOW)
    ws = WORD.findall(text)
    places, labels = [], set()
    for p, label in licences.PHRASES.items():
        p = p.split()
        at = [i for i in range(len(ws)) if ws[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    more, best = brute_windows(text)
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
            ",".join(sorted(more | labels)), 1.0 if places else best)


def brute_windows(text):
    """A window runs across line ends and has 1.25 times the template's words."""
    ws = WORD.findall((text or "").translate(LOW))
    labels, best = set(), 0.0
    for label, t in licences.TEMPLATES:
        wide, t = licences.span(t), set(t.split())
        n = max((len(t & set(ws[i:i + wide])) for i in range(len(ws))), default=0)
        if n >= math.ceil(licences.THRESHOLD * len(t) - 1e-9):
            labels.add(label)
            best = max(best, n / len(t))
    return labels, best


def test_query_against_brute_force(spark, awkward, tmp_path):
    extra = ["mit license mit license", "MIT-License and K license cc\x00by", "amit license mit licenses", "éapache license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documents",
             "x\nThis Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\ny",
             "gnu general public general public license gnu GENERAL public license", "Licensed under CC BY-NC 4.0."]
    rows = [tuple(r) for r in awkward.collect()]
    rows += [(900 + i, t, *rows[0][2:]) for i, t in enumerate(extra)]
    mpl = dict((x, t) for x, t in licences.TEMPLATES)["mpl"].upper().split()
    filler = ["filler"] * 30
    rows += [(950, "\n".join(mpl), *rows[0][2:]), (951, " ".join(w for x in mpl for w in [x, *filler]), *rows[0][2:]),
             (952, " ".join(["filler"] * 60 + mpl), *rows[0][2:])]  # wrapped, scattered, across a block's end
    df = spark.createDataFrame(rows, awkward.schema)
    folder = fixture(spark, tmp_path, "documents", df)
    got = [tuple(r) for r in op6_licences(spark, folder).collect()]
    want = [(r[0], *brute(r[1])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    labels = {r[0]: r[6] for r in got}
    assert (labels[950], labels[951], labels[952]) == ("mpl", "", "mpl")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.execute(op6()).fetchall(), key=str) == sorted(want, key=str)


def test_empty_table(nothing):
    assert licences.scan(nothing).count() == 0


def test_notices_across_lines_and_scattered_words(spark):
    rng = random.Random(4)
    fill = [f"w{k}" for k in range(50)]
    wrap = lambda ws, n: "\n * ".join(" ".join(ws[i:i + n]) for i in range(0, len(ws), n))
    some = lambda n: [rng.choice(fill) for _ in range(n)]
    texts, want = [], []
    for label, t in licences.TEMPLATES:
        for before in (0, 1, 61, 63, 64, 70, 300):  # windows at and across the ends of blocks
            texts.append(wrap(some(before) + t.upper().split() + some(40), 3))
            want.append(label)
        ws = t.split()
        texts.append(" ".join(w for x in ws for w in [x, *some(30)]))  # one line, every word, far apart
        want.append(None)
        ws.insert(len(ws) // 2, "extra")  # a word more than the template
        texts.append(wrap(some(50) + ws + some(9), 4))
        want.append(label)
    for _ in range(60):  # words of the templates in any order, dropped and spread
        ws = [w for x in rng.choice(licences.TEMPLATES)[1].split() for w in [x] * (rng.random() < 0.96) + some(rng.random() < 0.2)]
        rng.shuffle(ws) if rng.random() < 0.3 else None
        texts.append(wrap(some(rng.randint(0, 150)) + ws + some(rng.randint(0, 150)), rng.randint(2, 90)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    for k, t in enumerate(texts):
        labels, best = brute_windows(t)
        base = set(filter(None, got[k].base_labels.split(",")))
        assert got[k].labels == ",".join(sorted(base | labels)), t
        assert got[k].score == (1.0 if base else best), t
        if k < len(want):
            assert want[k] in labels if want[k] else not labels, t


def test_words_are_counted_in_every_document(spark):
    """More rows than a sample would take: each count is that of the whole table."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "The LICENSE, the licence").when(F.col("id") % 1000 == 1, "mozilla\u212a public").alias("text"))
    n = licences.word_frequencies(df, "text", ["the", "license", "mozilla", "mozillak", "public", "absent"])
    assert n == {"the": 10_000, "license": 10_000, "public": 20}

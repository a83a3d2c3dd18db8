import hashlib
import math
import re

from hearth.llm import mixing
from hearth.llm.queries import op1_mixing
from pyspark.sql import functions as F

from .conftest import fixture


def brute(rows):
    docs = [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in rows]
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, x in docs if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target = {s: 0.0 for s in sources}
    left, free = 1.5 * sum(size.values()), list(sources)
    while free:  # share by weight; what is above a cap goes round again
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * size[s]]
        if not full:
            for s in free:
                target[s] = level * weight[s]
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    out = []
    for s in sources:
        mine = sorted((hashlib.md5(f"0:{'' if d is None else d}".encode()).hexdigest(), n, d) for d, n, x in docs if x == s)
        whole, start = int(target[s] // size[s]) if size[s] else 0, 0
        for _, n, d in mine:
            more = 2 * start + n <= 2 * (target[s] - whole * size[s])
            out.append((d, n, size[s], round(target[s], 6), n * min(2, whole + more)))
            start += n
    return out


def key(r):
    return str(r)


def test_query_against_brute_force(spark, awkward, tmp_path):
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken)
           for r in op1_mixing(spark, fixture(spark, tmp_path, "documents", awkward)).collect()]
    assert sorted(got, key=key) == sorted(brute(awkward.collect()), key=key)
    again = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken)
             for r in op1_mixing(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(again, key=key)


def test_taken_is_near_target(spark, scratch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 40 + 1).alias("n"),
                                    F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"))
    rows = mixing.mix(docs, F.col("n"), scratch, ["doc_id"]).collect()
    by = {}
    for r in rows:
        assert 0 <= r._epochs <= 2
        t = by.setdefault(r.source, [r._target, 0])
        t[1] += r._epochs * r.n
    assert all(abs(t - n) <= 20 for t, n in by.values())
    assert math.isclose(sum(t for t, _ in by.values()), 1.5 * sum(r.n for r in rows))


def test_keeps_columns_and_empty_table(spark, awkward, nothing, scratch):
    out = mixing.mix(awkward, mixing.word_count(F.col("text")), scratch, ["doc_id", "text"])
    assert out.columns[:-4] == awkward.columns and out.count() == awkward.count()
    assert mixing.mix(nothing, mixing.word_count(F.col("text")), mixing.Scratch(spark, "t"), ["doc_id"]).count() == 0

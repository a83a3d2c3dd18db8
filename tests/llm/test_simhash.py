import numpy as np
import xxhash

from hearth.llm import simhash
from hearth.llm.queries import op2_simhash

from .conftest import fixture


def slow_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_query_against_brute_force(spark, awkward, tmp_path):
    rows = awkward.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    comp = slow_components(fps)
    low = {}
    for r, c in zip(rows, comp):
        if r.doc_id is not None:
            low[c] = min(low.get(c, r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{f:016x}", low.get(c)) for r, f, c in zip(rows, fps, comp)]
    got = [tuple(r) for r in op2_simhash(spark, fixture(spark, tmp_path, "documents", awkward)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_links_are_exact_over_tiles(spark, scratch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, 60, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base.tolist():  # chains and clusters around each
        x = b
        for _ in range(8):
            x ^= 1 << int(rng.integers(0, 62))
            fps.add(x)
    fps = sorted(fps)
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), scratch, 2, tile=4)
    roots = {r.node: r.root for r in simhash.components(found, scratch).collect()}
    got = [roots.get(f, f) for f in fps]
    comp = slow_components([f & (2 ** 64 - 1) for f in fps])
    want = {}
    for f, c in zip(fps, comp):
        want[c] = min(want.get(c, f), f)
    assert got == [want[c] for c in comp]


def test_one_of_each(spark, awkward, nothing, scratch):
    rows = awkward.collect()
    comp = slow_components([slow_fingerprint(r.text) for r in rows])
    kept = simhash.one_of_each(awkward, scratch).collect()
    assert len(kept) == len(set(comp))
    texts = {r.text for r in rows}
    assert all(r.text in texts for r in kept)
    assert simhash.one_of_each(nothing, simhash.Scratch(spark, "t")).count() == 0


def test_chain_components(spark, scratch):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1000, 1002)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges, scratch).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000, 1002: 1000}

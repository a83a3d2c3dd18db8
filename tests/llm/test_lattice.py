import numpy as np

from hearth.llm import lattice
from hearth.llm.queries import op8_embeddings

from .conftest import fixture


def brute(rows, cosine=lattice.COSINE):
    vec = [None if v is None or None in v or not np.isfinite(np.array(v, float)).all() or not np.any(v)
           else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if vec[i] is not None and vec[j] is not None and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [(k, links[i], low.get(find(i)), k is not None and k == low.get(find(i))) for i, (k, _) in enumerate(rows)]


def make(seed, clusters=25, size=12, noise=0.02, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        rows += [(centre + noise * rng.standard_normal(dim)).astype(np.float32).tolist() for _ in range(size)]
    return rows


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lattice, "PART", 8)  # cells in several parts
    vecs = make(1)
    vecs += [vecs[0]] * 5 + [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    vecs += [[-x for x in vecs[0]], [3 * x for x in vecs[1]]]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(None, vecs[2]), (None, None), (7, vecs[7]), (3, vecs[40])]
    df = spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], "vec_id long, embedding array<float>, label int, name string, id long")
    got = [tuple(r) for r in op8_embeddings(spark, fixture(spark, tmp_path, "embeddings", df)).collect()]
    want = brute([(k, v) for k, v in rows])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lattice.near_duplicates(df.limit(0), lattice.Scratch(spark, "t")).count() == 0


def test_recall_of_links_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    recall = []
    for cosine in (0.95, 0.97):
        b = rng.standard_normal(a.shape)
        b -= (b * a).sum(axis=1, keepdims=True) * a
        b = cosine * a + np.sqrt(1 - cosine ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        at = lattice.Lattice(64)
        x, y = at.cells(a), at.cells(b)
        recall.append((lattice._first_common(x, y) != np.iinfo(np.uint64).max).mean())
    assert recall[0] >= 0.97 and recall[1] >= 0.999


def test_nearest_lattice_point():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 2, (300, 8))
    h = lattice.nearest_e8(x)
    d = ((x - h) ** 2).sum(axis=1)
    for v in lattice.minimal_vectors():  # a point is nearest if no neighbour of it is nearer
        assert (((x - h - v) ** 2).sum(axis=1) >= d - 1e-9).all()
    assert (h.sum(axis=1) % 2 == 0).all()

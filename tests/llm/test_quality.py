import re
from collections import Counter

import numpy as np

from hearth.llm import quality
from hearth.llm.queries import op7_quality
from pyspark.sql import functions as F

from .conftest import fixture, words

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def slow_stats(text):
    text = text or ""
    ws = WHITE.findall(text)
    lines = [x for x in text.split("\n") if WHITE.search(x)]
    win = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    rep = {j for i in range(len(ws) - 4) if win[tuple(ws[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep))


def slow_vector(s):
    n = max(s[0], 1)
    return [np.log1p(s[0]), np.log1p(s[1] / n), *(np.log1p(s[k] / n * 10) for k in (2, 3, 4))]


def test_query_against_brute_force(spark, awkward, tmp_path):
    rows = awkward.collect()
    want = []
    for r in rows:
        s = slow_stats(r.text)
        want.append((r.doc_id, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    out = op7_quality(spark, fixture(spark, tmp_path, "documents", awkward)).collect()
    assert sorted([tuple(r)[:7] for r in out], key=str) == sorted(want, key=str)
    assert all(not (r.base_failed and r.kept) for r in out)


def test_stats_of_repeats():
    import random
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "b ", "c\n", "a b c d e ", "##", "\n\n", "é "]) for _ in range(rng.randint(0, 40)))
        assert quality.text_stats(t) == slow_stats(t)


def brute_mcd(x, share=quality.CORE, steps=quality.STEPS):
    """Concentration steps from the same starts with exact medians and quantiles; the least determinant."""
    mid = np.median(x, axis=0)
    sd = np.maximum(1.4826 * np.median(np.abs(x - mid), axis=0), quality.FLOOR)
    starts = [(mid, np.diag(1 / sd ** 2), 1.0), (x.mean(axis=0), quality._scatter(np.cov(x.T, bias=True), 1.0)[0], 1.0),
              (mid, np.diag(1 / sd ** 2), 0.5 / share)]
    found = []
    for mu, inv, part in starts:
        for _ in range(steps):
            d = np.einsum("ni,ij,nj->n", x - mu, inv, x - mu)
            core = x[d <= np.quantile(d, share * part)]
            mu, part = core.mean(axis=0), 1.0
            inv, det = quality._scatter(np.cov(core.T, bias=True), len(core) / len(x))
        found.append((det, mu, inv))
    return min(found, key=lambda f: f[0])


def distances(x, mu, inv):
    return np.einsum("ni,ij,nj->n", x - mu, inv, x - mu)


def square(inv):
    full = np.zeros((5, 5))
    for v, (i, j) in zip(inv, quality.PAIRS):
        full[i, j] = full[j, i] = v
    return full


def test_mcd_resists_outliers(spark, scratch):
    rng = np.random.default_rng(0)
    a = rng.normal(0, 1, (4000, 5)) @ np.diag([2, 1, 1, 1, 3]) + 15
    a[:800] = rng.normal(60, 1, (800, 5))  # a fifth of the group
    rows = [(0, "en", "s", x.tolist()) for x in a]
    est = quality.mcd(spark.createDataFrame(rows, "level int, lang string, source string, x array<double>"), scratch).head()
    det, mu, inv = brute_mcd(a)
    assert np.allclose(est.mu, mu, atol=0.15) and np.allclose(est.mu, 15, atol=0.3) and 0.8 < est.det / det < 1.25
    ours, theirs = distances(a, np.array(est.mu), square(est.inv)), distances(a, mu, inv)
    limit = quality._chi2_quantile(1 - quality.TAIL)
    assert ((ours > limit) == (theirs > limit)).mean() > 0.999
    assert (ours[:800] > limit).all() and (ours[800:] <= limit).all()


def test_the_least_determinant_counts(spark, scratch):
    """Means and covariance of all rows are drawn away by a far cluster; medians are not."""
    rng = np.random.default_rng(3)
    a = rng.normal(10, 1, (1000, 5))
    a[:240] = rng.normal(13, 0.05, (240, 5))  # a dense cluster near by
    rows = [(0, "en", "s", x.tolist()) for x in a]
    est = quality.mcd(spark.createDataFrame(rows, "level int, lang string, source string, x array<double>"), scratch).head()
    det = brute_mcd(a)[0]
    assert 0.7 < est.det / det < 1.4


def test_chi_square():
    assert abs(quality._chi2(quality._chi2_quantile(0.999), 5) - 0.999) < 1e-9
    assert abs(quality._chi2_quantile(0.999) - 20.515) < 1e-2 and abs(quality._chi2_quantile(0.5) - 4.351) < 1e-2


def clean_and_junk(rng, n, junk, lang="en"):
    rows = [(i, words(rng, rng.randint(20, 400)), lang, "hot" if i % 3 else "s") for i in range(n)]
    return rows + [(100_000 + i, " ".join(w + "$$$%%%" for w in words(rng, 60).split()), lang, "hot") for i in range(junk)]


def test_junk_goes_and_clean_text_stays(spark, scratch, nothing):
    import random
    rng = random.Random(6)
    schema = "doc_id long, text string, lang string, source string"
    for n, junk in ((600, 30), (40, 3)):  # the second table is smaller than a group that is estimated
        out = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(clean_and_junk(rng, n, junk), schema), scratch).collect()}
        assert all(k == (i < 100_000) for i, k in out.items()), (n, junk)
        scratch = quality.Scratch(spark, "t")
    one = spark.createDataFrame([(1, words(rng, 30), "en", "s"), (2, "short", "en", "s")], schema)
    assert {r.doc_id: r.kept for r in quality.judge(one, quality.Scratch(spark, "t")).collect()} == {1: True, 2: False}
    assert quality.judge(nothing, quality.Scratch(spark, "t"), carry=True).count() == 0


def test_verdict_of_the_query_against_brute_force(spark, tmp_path):
    """Distances and verdicts over groups of every size, planted outliers among them."""
    import random
    rng = random.Random(8)
    rows = clean_and_junk(rng, 700, 40)
    rows += [(i + 2000, words(rng, rng.randint(10, 60)), "de", f"s{i % 4}") for i in range(160)]  # small groups, a large language
    rows += [(i + 3000, words(rng, rng.randint(200, 260)), None, None) for i in range(30)]  # a small language
    rows += [(4000 + i, " ".join(["verylongwordindeed" * 9] * 40) + f" {i}", "de", "s1") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r for r in op7_quality(spark, fixture(spark, tmp_path, "documents", df)).collect()}
    stats = {r[0]: slow_stats(r[1]) for r in rows}
    ok = [r for r in rows if stats[r[0]][0] >= 10 and 100 * stats[r[0]][4] <= 20 * stats[r[0]][0]]
    x = {r[0]: np.array(slow_vector(stats[r[0]])) for r in ok}
    size = Counter((r[2], r[3]) for r in ok), Counter(r[2] for r in ok)
    near = 0
    for r in ok:
        group = [o for o in ok if size[0][r[2:]] < 100 or o[2:] == r[2:]]
        group = [o for o in group if size[0][r[2:]] >= 100 or size[1][r[2]] < 100 or o[2] == r[2]]
        key = tuple(o[0] for o in group)
        if key not in _fits:
            _fits[key] = brute_mcd(np.array([x[k] for k in key]))
        _, mu, inv = _fits[key]
        d = float(distances(x[r[0]][None], mu, inv)[0])
        limit = quality._chi2_quantile(1 - quality.TAIL) * len(group) / (len(group) - 7)
        assert abs(got[r[0]].distance - d) < 0.25 * d + 0.5, (r[0], got[r[0]].distance, d)
        if abs(d - limit) > 0.3 * limit:
            assert got[r[0]].kept == (d <= limit)
        else:
            near += 1
    assert near < 5 and sum(not got[r[0]].kept for r in ok) >= 40


_fits = {}


def test_labelled_documents(spark, scratch):
    sf = "/root/testdata/sf0.01"
    out = op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    c = {(r.quality, r.base_failed, r.kept): r["count"] for r in out.groupBy("quality", "base_failed", "kept").count().collect()}
    assert not c.get((1, False, False)) and not c.get((0, False, True))
    assert F is not None

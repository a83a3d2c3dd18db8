import hashlib
import os
import random
import subprocess
import sys
import zlib

import numpy as np

import corpus_pipeline
from hearth.llm import quality, tokens
from hearth.llm.common import Scratch
from hearth.llm.queries import QUERIES

from .conftest import fixture
from .test_quality import brute_mcd, clean_and_junk, distances, slow_stats, slow_vector
from .test_simhash import slow_components, slow_fingerprint
from .test_suffixes import brute as slow_suffixes

REPO = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages_against_brute_force(spark, awkward, tmp_path):
    sf = fixture(spark, tmp_path, "documents", awkward)
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "test")
    tables = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == docs.columns
        docs = scratch.save(out, f"s{k}")
        tables.append(docs.collect())
    start, good, single, cut, mixed, packed = tables
    ok = lambda s: s[0] >= 10 and 100 * s[4] <= 20 * s[0]
    # every group is small here, so all rows that pass the base rules make one estimate
    passed = [r for r in start if ok(slow_stats(r.text))]
    x = np.array([slow_vector(slow_stats(r.text)) for r in passed])
    _, mu, inv = brute_mcd(x)
    d, limit = distances(x, mu, inv), quality._chi2_quantile(1 - quality.TAIL) * len(x) / (len(x) - 7)
    sure, far = d < 0.7 * limit, d > 1.4 * limit  # medians and quantiles are binned in the operator
    assert len(passed) < quality.MIN_GROUP and (sure | far).mean() > 0.95
    found = {str(r) for r in good}
    assert {str(r) for r, s in zip(passed, sure) if s} <= found <= {str(r) for r, f in zip(passed, far) if not f}
    assert len(good) == sum(str(r) in found for r in passed)
    comp = slow_components([slow_fingerprint(r.text) for r in good])
    assert len(single) == len(set(comp)) and {str(r) for r in single} <= {str(r) for r in good}
    want = {r[0]: r for r in slow_suffixes([(r.doc_id, r.text) for r in single])}
    for a, b in zip(sorted(single, key=lambda r: str((r.doc_id, r.text))), sorted(cut, key=lambda r: str((r.doc_id, r.text)))):
        if a.doc_id == b.doc_id is not None and want[a.doc_id][2] == 0:
            assert a == b
    by_hash = {r[4] for r in slow_suffixes([(r.doc_id, r.text) for r in single])}
    same = [hashlib.sha256((r.text or "").encode()).hexdigest() in by_hash for r in cut]
    assert sum(same) >= len(same) - 3  # but for spans that end inside a character
    assert {str(r) for r in mixed} <= {str(r) for r in cut}
    assert max(sum(r == x for x in mixed) for r in cut) <= 2
    tok = tokens.tokenizer(tokens.default_path())
    pieces = []
    for r in mixed:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        pieces += [(r.doc_id, p, zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(pieces, key=str) == sorted([(r.doc_id, r.piece, r.ids_crc32) for r in packed], key=str)


def test_quality_stage_drops_planted_outliers(spark):
    rows = [(*r, len(r[1])) for r in clean_and_junk(random.Random(4), 300, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert sorted(kept.collect()) == sorted(docs.where("doc_id < 100000").collect())


def test_empty_documents(spark, nothing, tmp_path):
    assert corpus_pipeline.run(spark, fixture(spark, tmp_path, "documents", nothing)).count() == 0


def test_registration():
    import __spark_entry__ as entry
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_entry_works_without_the_subpackage():
    code = ("import sys; sys.modules['hearth.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') or x == 'pipeline' for x in q); "
            "assert set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)

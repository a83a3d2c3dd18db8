"""Empty inputs flow through every operator family without errors."""

import numpy as np
import pytest

from hearth.operators import encode as E
from hearth.operators import fitting as M
from hearth.operators import metrics as A
from hearth.operators import positional as P
from hearth.operators import scoring as R


def test_positional_on_empty(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert P.slice_range(df, "k", 0, 10, top_k_max_rows=0).count() == 0
    assert P.batch_summary(df, "k", 4).count() == 0
    idx = P.PositionIndex.build(df, "k")
    assert idx.total == 0 and idx.with_position(df).count() == 0


def test_encode_and_score_on_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vocab = E.build_vocab(docs, "text", 10)
    assert E.encode(docs, "doc_id", "text", vocab, 8).count() == 0
    feats = spark.createDataFrame([], "id long, x array<double>, label int")
    scored = R.score_table(feats, "x", np.ones((3, 2)), label="label")
    m = A.evaluate(scored).collect()[0]
    assert m.n_labelled == 0 and m.accuracy is None


def test_fit_on_empty_raises_cleanly(spark):
    feats = spark.createDataFrame([], "id long, x array<double>, label int")
    with pytest.raises(ValueError):
        M.fit_lstsq(feats, "x", "label", 3)


def test_read_excel_is_gated(spark):
    from hearth.sources import read_excel
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="openpyxl"):
            read_excel(spark, "/nonexistent.xlsx")

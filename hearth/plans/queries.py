"""The registered queries: one per inventoried operator.

Every query reads the supplied tables under ``sf_dir`` (or data Spark derives
from them) and returns a lazy DataFrame. Doubles are rounded to 6 places so the
result can be compared with the DuckDB oracle regardless of summation order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions.arrays import argmax
from hearth.functions.text import URL_STRIP, url_key
from hearth.operators import columns as P
from hearth.operators import encode as Tx
from hearth.operators import fileorder as Fo
from hearth.operators import fitting as M
from hearth.operators import flags as Fl
from hearth.operators import keyed as K
from hearth.operators import metrics as A
from hearth.operators import positional as Fp
from hearth.operators import scoring as R
from hearth.operators import snapshots as Sn
from hearth.operators import vectors as V
from hearth.plans.heads import class_names, fixed_head
from hearth.sources.tables import read_table, table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

NUM_CLASSES = 10
WIDTH = 64
VIEW_WIDTH = 16
N_VIEWS = 4
ROUNDS = (0, 1, 2)


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def load(spark: SparkSession, sf_dir: str, name: str, balance: bool = False) -> DataFrame:
    return read_table(spark, table_path(sf_dir, name), name, balance=balance)


def load_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for the tokenising queries (CPU-heavy per row): spread over the
    cores when the file has fewer splits than the default parallelism."""
    return load(spark, sf_dir, "documents", balance=True)


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- scoring (R, A)

def _scored(spark, sf_dir, label: bool = True) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings")
    return R.score_table(emb, "embedding", fixed_head(NUM_CLASSES, WIDTH),
                         label="label" if label else None, class_names=class_names(NUM_CLASSES))


@query("head_logits")
def q_head_logits(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    lg = R.head_logits(emb, "embedding", fixed_head(NUM_CLASSES, WIDTH))
    return lg.select("vec_id", F.posexplode_outer("logits").alias("class_id", "logit")) \
        .select("vec_id", "class_id", r6("logit").alias("logit"))


@query("project_chain")
def q_project_chain(spark, sf_dir):
    """Two affine maps with no activation (pre_classifier, classifier), folded."""
    emb = load(spark, sf_dir, "embeddings")
    w1 = fixed_head(WIDTH, WIDTH, 1) / WIDTH          # 64 -> 64
    w2 = fixed_head(NUM_CLASSES, WIDTH, 2)            # 64 -> 10
    b1 = [0.5] * WIDTH
    lg = R.head_logits(emb, "embedding", [(w1, b1), (w2, None)])
    return lg.select("vec_id", F.posexplode_outer("logits").alias("class_id", "logit")) \
        .select("vec_id", "class_id", r6("logit").alias("logit"))


@query("predict_class")
def q_predict_class(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "label", "pred")


@query("softmax")
def q_softmax(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    s = R.score(R.head_logits(emb, "embedding", fixed_head(NUM_CLASSES, WIDTH)),
                "logits", probabilities=True)
    return s.select("vec_id", F.posexplode_outer("probs").alias("class_id", "prob")) \
        .select("vec_id", "class_id", r6("prob").alias("prob"))


@query("predict_score")
def q_predict_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "pred", r6("score").alias("score"))


@query("class_name")
def q_class_name(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "pred", "pred_name")


@query("classify_struct")
def q_classify_struct(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    lg = R.head_logits(emb, "embedding", fixed_head(NUM_CLASSES, WIDTH))
    out = R.classify_struct(lg, "logits", class_names(NUM_CLASSES))
    return out.select("vec_id", F.col("result.label").alias("result_label"),
                      r6("result.score").alias("result_score"))


@query("score_table")
def q_score_table(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "label", "pred", r6("score").alias("score"),
                                         r6("nll").alias("nll"))


@query("mean_cross_entropy")
def q_mean_cross_entropy(spark, sf_dir):
    return A.evaluate(_scored(spark, sf_dir)).select(
        r6("mean_nll").alias("mean_nll"), "n_labelled")


@query("accuracy")
def q_accuracy(spark, sf_dir):
    return A.evaluate(_scored(spark, sf_dir)).select(
        r6("accuracy").alias("accuracy"), "n_correct", "n_labelled", "n_unlabelled",
        r6("mean_nll").alias("mean_nll"))


@query("correct_total")
def q_correct_total(spark, sf_dir):
    return A.correct_total(_scored(spark, sf_dir))


def _scored_rounds(spark, sf_dir, rounds=ROUNDS) -> DataFrame:
    """Every row scored by every round's head in one scan and one stacked matmul."""
    emb = load(spark, sf_dir, "embeddings")
    heads = [fixed_head(NUM_CLASSES, WIDTH, r) for r in rounds]
    lg = R.stacked_logits(emb, "embedding", heads, keep=["vec_id", "label"], head_col="round")
    return R.score(lg.withColumn("round", F.element_at(F.array(*[F.lit(r) for r in rounds]),
                                                      F.col("round") + 1)),
                   "logits", label="label")


@query("accuracy_by_round")
def q_accuracy_by_round(spark, sf_dir):
    return A.evaluate(_scored_rounds(spark, sf_dir), by=["round"]).select(
        "round", r6("accuracy").alias("accuracy"), "n_correct", r6("mean_nll").alias("mean_nll"))


def _two_rounds(spark, sf_dir) -> DataFrame:
    """Old (round 0) and new (round 1) predictions side by side, from one scan
    and without a shuffle: both heads are applied to the same row at once."""
    emb = load(spark, sf_dir, "embeddings")
    w = np.vstack([fixed_head(NUM_CLASSES, WIDTH, 0), fixed_head(NUM_CLASSES, WIDTH, 1)])
    both = V.project(emb, "embedding", w, out="_l")
    return both.select(
        "vec_id",
        argmax(F.slice("_l", 1, NUM_CLASSES)).alias("old_pred"),
        argmax(F.slice("_l", NUM_CLASSES + 1, NUM_CLASSES)).alias("new_pred"))


@query("compare_results")
def q_compare_results(spark, sf_dir):
    """Round-0 result vs round-1 result for the same rows: old x new counts."""
    _, confusion = A.compare_results(_two_rounds(spark, sf_dir), "old_pred", "new_pred")
    return confusion


@query("compare_summary")
def q_compare_summary(spark, sf_dir):
    summary, _ = A.compare_results(_two_rounds(spark, sf_dir), "old_pred", "new_pred")
    return summary.select("n_rows", "n_agree", r6("agreement").alias("agreement"))


# ------------------------------------------------------- positional (F1-F7, P1-P6)

DOC_COLS = ["doc_id", "lang", "source", "n_chars"]
SLICE_A, SLICE_B, BATCH = 160, 200, 64


@query("scan_documents")
def q_scan_documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(*DOC_COLS, F.length("text").alias("text_len"))


@query("row_count")
def q_row_count(spark, sf_dir):
    return Fp.row_count(load(spark, sf_dir, "documents"))


@query("slice_head")
def q_slice_head(spark, sf_dir):
    return Fp.head(load(spark, sf_dir, "documents").select(*DOC_COLS), "doc_id", SLICE_A)


@query("slice_range")
def q_slice_range(spark, sf_dir):
    return Fp.slice_range(load(spark, sf_dir, "documents").select(*DOC_COLS), "doc_id",
                          SLICE_A, SLICE_B)


@query("slice_range_indexed")
def q_slice_range_indexed(spark, sf_dir):
    """Same slice through the position index (the route deep slices take)."""
    return Fp.slice_range(load(spark, sf_dir, "documents").select(*DOC_COLS), "doc_id",
                          SLICE_A, SLICE_B, top_k_max_rows=0)


# Order keys beyond 2^53, decimals, texts and dates through the position index.
ORDER_KEYS = {
    "wide": "CAST(1152921504606846976 + doc_id AS BIGINT)",
    "decimal": "CAST(doc_id AS DECIMAL(38,0)) + CAST(1000000000000000000000000000000 AS DECIMAL(38,0))",
    "date": "date_add(DATE'2000-01-01', CAST(doc_id AS INT))",
}


def _keyed_docs(spark, sf_dir, kind):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.withColumn("k", F.expr(ORDER_KEYS[kind]))


def _register_index_queries():
    def add(kind):
        @query(f"index_slice_{kind}")
        def _slice(spark, sf_dir):
            d = Fp.slice_range(_keyed_docs(spark, sf_dir, kind), "k", SLICE_A, SLICE_B, top_k_max_rows=0)
            return d.select("doc_id", "lang", F.col("k").cast("string").alias("k"))

        @query(f"index_batch_{kind}")
        def _batch(spark, sf_dir):
            d = _keyed_docs(spark, sf_dir, kind)
            return Fp.with_batch(d, "k", 32).select("doc_id", "batch_id")

    for kind in ORDER_KEYS:
        add(kind)


_register_index_queries()


@query("index_slice_text")
def q_index_slice_text(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return Fp.slice_range(pages, "url", SLICE_A, SLICE_B, top_k_max_rows=0)


@query("index_batch_text")
def q_index_batch_text(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.format_string("doc-%012d", F.col("doc_id")).alias("k"))
    return Fp.with_batch(docs, "k", 32).select("doc_id", "batch_id")


@query("row_at")
def q_row_at(spark, sf_dir):
    return Fp.row_at(load(spark, sf_dir, "documents").select(*DOC_COLS), "doc_id", 170)


@query("split_positional")
def q_split_positional(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(*DOC_COLS)
    return Fp.split_positional(docs, "doc_id", [("train", 0, SLICE_A), ("test", SLICE_A, SLICE_B)])


@query("batch_summary")
def q_batch_summary(spark, sf_dir):
    return Fp.batch_summary(load(spark, sf_dir, "documents"), "doc_id", BATCH)


@query("batch_assign")
def q_batch_assign(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return Fp.with_batch(docs, "doc_id", BATCH, keep_position=True)


@query("first_batch")
def q_first_batch(spark, sf_dir):
    return Fp.first_batch(load(spark, sf_dir, "documents").select(*DOC_COLS), "doc_id", BATCH)


@query("file_slice")
def q_file_slice(spark, sf_dir):
    """Rows 160 to 199 as they stand in the file."""
    return Fo.FileOrder.build(spark, table_path(sf_dir, "documents")).slice(SLICE_A, SLICE_B).select(*DOC_COLS)


@query("file_batches")
def q_file_batches(spark, sf_dir):
    """Mini-batches of 64 consecutive rows of the file."""
    d = Fo.FileOrder.build(spark, table_path(sf_dir, "pages")).with_batch(64)
    return d.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("page_id").alias("first_key"),
                                     F.max("page_id").alias("last_key"))


@query("file_split")
def q_file_split(spark, sf_dir):
    """The first 160 rows and the next 40 of the file."""
    parts = [("train", 0, SLICE_A), ("test", SLICE_A, SLICE_B)]
    return Fo.FileOrder.build(spark, table_path(sf_dir, "events")).split(parts).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_key"), F.max("event_id").alias("last_key"))


@query("const_columns")
def q_const_columns(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return P.add_constants(docs, P.SCORE_DEFAULTS)


def _labelled_docs(spark, sf_dir) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "inner")


@query("label_swap")
def q_label_swap(spark, sf_dir):
    d = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return P.swap_labels(d, "quality", out="label")


@query("record_assembly")
def q_record_assembly(spark, sf_dir):
    d = P.swap_labels(_labelled_docs(spark, sf_dir), "quality", out="label")
    return P.assemble_record(d, "text", "label", key="doc_id")


@query("score_writeback")
def q_score_writeback(spark, sf_dir):
    """Score every row and write the class name and probability back onto the table."""
    emb = load(spark, sf_dir, "embeddings")
    base = P.add_constants(emb.select("vec_id", "label"), P.SCORE_DEFAULTS)
    s = R.score_table(emb, "embedding", fixed_head(NUM_CLASSES, WIDTH),
                      class_names=class_names(NUM_CLASSES))
    s = s.select("vec_id", F.col("pred_name").alias("new_result"),
                 F.col("score").alias("new_score"))
    out = P.write_back(base, s, "vec_id")
    return out.select("vec_id", "label", "new_result", r6("new_score").alias("new_score"))


# ------------------------------------------------------------------ encoder (T)

VOCAB, MAX_LEN = 1000, 128


def _ints_str(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), " ")


@query("token_counts")
def q_token_counts(spark, sf_dir):
    return Tx.token_counts(load_text(spark, sf_dir), "doc_id", "text")


@query("vocab_top")
def q_vocab_top(spark, sf_dir):
    return Tx.build_vocab(load_text(spark, sf_dir), "text", VOCAB)


def _encoded(spark, sf_dir) -> DataFrame:
    docs = load_text(spark, sf_dir)
    vocab, nbytes = Tx.prepare_vocab(docs, "text", VOCAB)
    return Tx.encode(docs, "doc_id", "text", vocab, MAX_LEN, vocab_size_bytes=nbytes)


@query("encode_ids")
def q_encode_ids(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", "n_tokens", F.size("input_ids").alias("length"),
                    _ints_str(F.col("input_ids")).alias("input_ids"))


@query("attention_mask")
def q_attention_mask(spark, sf_dir):
    e = Tx.attention_mask(load_text(spark, sf_dir), "doc_id", "text", MAX_LEN)
    return e.select("doc_id", F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("mask_sum"),
                    _ints_str(F.col("attention_mask")).alias("attention_mask"))


@query("encoded_reuse")
def q_encoded_reuse(spark, sf_dir):
    """Encode once, write the encoded table under the checkpoint folder, and run
    later work on the written table (lineage cut, no re-tokenising)."""
    import uuid

    from hearth.sources.sinks import materialise
    enc = materialise(_encoded(spark, sf_dir), f"encoded-{uuid.uuid4().hex}")
    return enc.select("doc_id", "n_tokens",
                      F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).alias("mask_sum"),
                      F.size("input_ids").alias("length"),
                      F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, v: a + v).alias("id_sum"))


@query("truncation_report")
def q_truncation_report(spark, sf_dir):
    return Tx.truncation_report(load_text(spark, sf_dir), "doc_id", "text", MAX_LEN)


@query("empty_input_guard")
def q_empty_input_guard(spark, sf_dir):
    return Tx.empty_input_summary(load_text(spark, sf_dir), "text")


# ---------------------------------------------------------- flags (F8-F12), keyed (K)

PATTERNS = ["src1", "src5"]
REPORT_PATTERNS = ["src1", "src5", "src99", "SRC1"]
TARGETS = ["example.org"]
REPORT_TARGETS = ["example.org", "example.com", "example"]


def _docs_flag_input(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("flag_any_substring")
def q_flag_any_substring(spark, sf_dir):
    return Fl.flag_any(_docs_flag_input(spark, sf_dir), "source", PATTERNS) \
        .select("doc_id", "source", "flag")


@query("flag_additive")
def q_flag_additive(spark, sf_dir):
    d = _docs_flag_input(spark, sf_dir).withColumn("flag", F.col("lang") == "en")
    return Fl.flag_additive(d, "source", PATTERNS, "flag").select("doc_id", "lang", "source", "flag")


@query("flag_inverse")
def q_flag_inverse(spark, sf_dir):
    return Fl.flag_inverse(_docs_flag_input(spark, sf_dir), "source", PATTERNS) \
        .select("doc_id", "source", "flag")


@query("list_flagged")
def q_list_flagged(spark, sf_dir):
    return Fl.list_flagged(Fl.flag_any(_docs_flag_input(spark, sf_dir), "source", PATTERNS),
                           "doc_id")


@query("pattern_report")
def q_pattern_report(spark, sf_dir):
    return Fl.pattern_report(_docs_flag_input(spark, sf_dir), "source", REPORT_PATTERNS)


def _hosts(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", "url", url_key("url").alias("key"))


@query("match_suffix")
def q_match_suffix(spark, sf_dir):
    return Fl.flag_targets(_hosts(spark, sf_dir), "key", TARGETS, "matched") \
        .select("page_id", "key", "matched")


@query("target_report")
def q_target_report(spark, sf_dir):
    return Fl.pattern_report(_hosts(spark, sf_dir), "key", REPORT_TARGETS, mode="target")


@query("key_normalise")
def q_key_normalise(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return K.normalise_keys(pages, "url", URL_STRIP, "stripped") \
        .select("page_id", "stripped", url_key("url").alias("key"))


@query("last_write_wins")
def q_last_write_wins(spark, sf_dir):
    return K.last_write_wins(_hosts(spark, sf_dir), "key", ["url"], "page_id")


def _snapshots(spark, sf_dir):
    """Two snapshots of the same keyed table: the rows of even page ids are the base,
    those of odd ones the update; each is reduced to one row per key."""
    h = _hosts(spark, sf_dir)
    base = K.last_write_wins(h.filter(F.col("page_id") % 2 == 0), "key", ["url"], "page_id")
    upd = K.last_write_wins(h.filter(F.col("page_id") % 2 != 0), "key", ["url"], "page_id")
    return base, upd


@query("snapshot_overlay")
def q_snapshot_overlay(spark, sf_dir):
    base, upd = _snapshots(spark, sf_dir)
    return K.overlay(base, upd, "key", ["url"])


MANY_PATTERNS = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
RARE_PATTERNS = [p + c for p in ("qu", "zz", "Xy") for c in "abcdefghijklmnopqrstuvwxyz"]
MANY_TARGETS = ["example.org", "example.com", "example", "org", "com", *(f"site{i}.example.org" for i in range(500))]


@query("flag_any_many")
def q_flag_any_many(spark, sf_dir):
    return Fl.flag_any_many(load_text(spark, sf_dir), "text", RARE_PATTERNS).select("doc_id", "flag")


@query("pattern_report_many")
def q_pattern_report_many(spark, sf_dir):
    return Fl.pattern_report_many(load_text(spark, sf_dir), "text", MANY_PATTERNS)


@query("match_targets_many")
def q_match_targets_many(spark, sf_dir):
    return Fl.match_targets(_hosts(spark, sf_dir), "page_id", "key", MANY_TARGETS)


@query("target_report_many")
def q_target_report_many(spark, sf_dir):
    return Fl.target_report_many(_hosts(spark, sf_dir), "page_id", "key", MANY_TARGETS)


CHAIN = 5


def _chain(spark, sf_dir) -> Sn.SnapshotChain:
    """Five snapshots of one keyed table: page ids by their remainder modulo 5, 0 the base."""
    h = _hosts(spark, sf_dir)
    part = lambda v: K.last_write_wins(h.filter(F.col("page_id") % CHAIN == v), "key", ["url"], "page_id")
    chain = Sn.SnapshotChain(spark, _shared(spark, "chain"), "key", ["url"], buckets=16).start(part(0))
    for v in range(1, CHAIN):
        chain.append(part(v), v)
    return chain


@query("snapshot_chain")
def q_snapshot_chain(spark, sf_dir):
    """Versions 2 and 4 of the chain, each in one pass."""
    chain = _chain(spark, sf_dir)
    return chain.as_of(2).withColumn("version", F.lit(2)).unionByName(chain.as_of(4).withColumn("version", F.lit(4)))


@query("snapshot_compacted")
def q_snapshot_compacted(spark, sf_dir):
    """The last version after the first three deltas were folded into the base."""
    chain = _chain(spark, sf_dir)
    chain.compact(3)
    return chain.as_of(4)


@query("key_drift")
def q_key_drift(spark, sf_dir):
    base, upd = _snapshots(spark, sf_dir)
    return K.key_drift(base, upd, "key")


@query("flagged_share")
def q_flagged_share(spark, sf_dir):
    d = Fl.flag_any(_docs_flag_input(spark, sf_dir), "source", PATTERNS)
    return K.flagged_share(d, "flag", "n_chars").select(
        "n_flagged", "n_total", r6("share").alias("share"))


# ------------------------------------------------------------------ vectors (V)

def _long(df: DataFrame, key: str, arr: str, j: str = "j", v: str = "v") -> DataFrame:
    return df.select(key, F.posexplode_outer(arr).alias(j, v)) \
        .select(key, j, r6(F.col(v).cast("double")).alias(v))


def _views(spark, sf_dir) -> DataFrame:
    emb = load(spark, sf_dir, "embeddings")
    for k in range(1, N_VIEWS + 1):
        emb = V.view_pick(emb, "embedding", k, VIEW_WIDTH, out=f"view{k}")
    return emb


@query("view_pick")
def q_view_pick(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    return _long(V.view_pick(emb, "embedding", 2, VIEW_WIDTH), "vec_id", "view")


@query("layer_views")
def q_layer_views(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    lv = V.layer_views(emb, "embedding", VIEW_WIDTH, N_VIEWS, keep=["vec_id"])
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    return lv.select("vec_id", F.col("view").cast("int").alias("view"), r6(norm).alias("l2"),
                     r6(F.element_at("vec", 1).cast("double")).alias("first"))


@query("pool_first")
def q_pool_first(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations")
    return V.pool_first(conv, "conv_id", "turn", "text", out="first_text") \
        .select("conv_id", "first_text", F.col("first_text_turn").alias("first_turn"))


PROJ_OUT = 72   # 72 x 64 weights: above the JVM threshold, so the Arrow matmul runs


@query("project_wide")
def q_project_wide(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    w = fixed_head(PROJ_OUT, WIDTH, 3) / 8.0
    return _long(V.project(emb, "embedding", w, out="y"), "vec_id", "y", "k", "y")


@query("vec_sum")
def q_vec_sum(spark, sf_dir):
    d = V.vec_sum(_views(spark, sf_dir), [f"view{k}" for k in range(1, N_VIEWS + 1)], "s")
    return _long(d, "vec_id", "s")


@query("vec_concat")
def q_vec_concat(spark, sf_dir):
    d = V.vec_concat(_views(spark, sf_dir), ["view4", "view1"], "c", widths=[VIEW_WIDTH] * 2)
    return _long(d, "vec_id", "c")


@query("one_hot")
def q_one_hot(spark, sf_dir):
    d = V.one_hot(load(spark, sf_dir, "embeddings"), "label", NUM_CLASSES)
    return d.select("vec_id", "label",
                    _ints_str(F.transform("one_hot", lambda v: v.cast("int"))).alias("one_hot"))


@query("shape_profile")
def q_shape_profile(spark, sf_dir):
    return V.shape_profile(load(spark, sf_dir, "embeddings"), ["embedding"])


# ------------------------------------------------------------ head fitting (M)

TRAIN_FRACTION = 0.8


def _split_embeddings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """First 80% of rows by ``vec_id`` for fitting, the rest held out; both sides
    are key-range filters pushed into the scan."""
    emb = load(spark, sf_dir, "embeddings")
    first, rest = Fp.split_predicates(emb, "vec_id", TRAIN_FRACTION)
    return emb.filter(first), emb.filter(rest)


@query("gram_matrix")
def q_gram_matrix(spark, sf_dir):
    g = M.gram_sums(load(spark, sf_dir, "embeddings"), "embedding", "label", NUM_CLASSES)
    return g.select("i", "j", r6("value").alias("value"))


def _heads_long(w) -> list[tuple[int, int, float]]:
    return [(int(c), int(j), float(round(w[c, j], 6)))
            for c in range(w.shape[0]) for j in range(w.shape[1])]


@query("lstsq_fit")
def q_lstsq_fit(spark, sf_dir):
    """Weights of the closed-form head fitted on the train split (K x d rows)."""
    train, _ = _split_embeddings(spark, sf_dir)
    w = M.fit_lstsq(train, "embedding", "label", NUM_CLASSES)
    return spark.createDataFrame(_heads_long(w), "class_id int, j int, w double")


@query("lstsq_eval")
def q_lstsq_eval(spark, sf_dir):
    """Closed-form head fitted on train, scored on the held-out rows."""
    train, test = _split_embeddings(spark, sf_dir)
    w = M.fit_lstsq(train, "embedding", "label", NUM_CLASSES)
    return R.score_table(test, "embedding", w, label="label") \
        .select("vec_id", "label", "pred", r6("score").alias("score"))


@query("head_fit")
def q_head_fit(spark, sf_dir):
    """Softmax head (multinomial logistic regression) on frozen features."""
    train, test = _split_embeddings(spark, sf_dir)
    model = M.fit_softmax_head(train, "embedding", "label", max_iter=50)
    w, b = M.softmax_head_weights(model)
    return R.score_table(test, "embedding", w, b, label="label") \
        .select("vec_id", "label", "pred", r6("score").alias("score"))


OPTIMUM_FEATURES, OPTIMUM_STEP = (0, 21, 42, 63), 0.5


@query("head_fit_optimum")
def q_head_fit_optimum(spark, sf_dir):
    """The fitted softmax head against heads that differ from it in one weight: the mean
    cross-entropy of the rows it was fitted on is above its own for each of them."""
    train, _ = _split_embeddings(spark, sf_dir)
    w, b = M.softmax_head_weights(M.fit_softmax_head(train, "embedding", "label", max_iter=200))
    moves = [(c, j, s) for c in range(NUM_CLASSES) for j in OPTIMUM_FEATURES for s in (1, -1)]
    heads = [(w, b)]
    for c, j, s in moves:
        moved = w.copy()
        moved[c, j] += s * OPTIMUM_STEP
        heads.append((moved, b))
    lg = R.stacked_logits(train, "embedding", heads, keep=["vec_id", "label"], head_col="h")
    loss = A.evaluate(R.score(lg, "logits", label="label"), by=["h"]).select("h", "n_labelled", "mean_nll")
    own = loss.where("h = 0").select(F.col("h").alias("of"), F.col("mean_nll").alias("own"))
    named = spark.createDataFrame([(k + 1, 0, *m) for k, m in enumerate(moves)], "k int, of int, class int, feature int, sign int")
    return loss.join(named, F.col("h") == F.col("k")).join(own, "of").select(
        "class", "feature", "sign", F.col("n_labelled").alias("n_rows"), (F.col("mean_nll") > F.col("own")).alias("higher"))


@query("head_per_view")
def q_head_per_view(spark, sf_dir):
    """One closed-form head per layer view: the views' Gram matrices are blocks of the one
    over the whole vector, and all heads score the held-out rows in one stacked matmul."""
    train, test = _split_embeddings(spark, sf_dir)
    eye = np.eye(WIDTH)
    maps = {str(k + 1): eye[k * VIEW_WIDTH:(k + 1) * VIEW_WIDTH] for k in range(N_VIEWS)}
    heads = M.fit_mapped_heads(train, "embedding", "label", NUM_CLASSES, maps)
    views = sorted(heads, key=int)
    lg = R.stacked_logits(test, "embedding", [heads[g] for g in views], keep=["vec_id", "label"], head_col="view")
    lg = lg.withColumn("view", F.element_at(F.array(*[F.lit(int(g)) for g in views]),
                                            F.col("view") + 1))
    scored = R.score(lg, "logits", label="label")
    return A.evaluate(scored, by=["view"]).select(
        F.col("view").cast("int").alias("view"), r6("accuracy").alias("accuracy"),
        "n_correct", "n_labelled")


@query("fused_head")
def q_fused_head(spark, sf_dir):
    """Side branches of views 1-3 projected and summed, concatenated with view 4, then a
    closed-form head on the fused vector. The branches are affine: they fold into one map."""
    train, test = _split_embeddings(spark, sf_dir)
    fuse = np.zeros((2 * VIEW_WIDTH, WIDTH))
    for k in (1, 2, 3):
        fuse[:VIEW_WIDTH, (k - 1) * VIEW_WIDTH:k * VIEW_WIDTH] = fixed_head(VIEW_WIDTH, VIEW_WIDTH, 4 + k) / 4.0
    fuse[VIEW_WIDTH:, 3 * VIEW_WIDTH:] = np.eye(VIEW_WIDTH)
    w = M.fit_mapped_heads(train, "embedding", "label", NUM_CLASSES, {"fused": fuse})["fused"]
    scored = R.score_table(test, "embedding", w, label="label")
    return A.evaluate(scored).select(r6("accuracy").alias("accuracy"), "n_correct", "n_labelled")


FIT_ROUNDS = (1, 3, 10)


@query("fit_rounds")
def q_fit_rounds(spark, sf_dir):
    """Fit + evaluate rounds, each going on from the weights of the last; one metrics row
    per round, scored in one pass over the held-out rows."""
    train, test = _split_embeddings(spark, sf_dir)
    wb = M.fit_rounds(train, "embedding", "label", NUM_CLASSES, FIT_ROUNDS)
    lg = R.stacked_logits(test, "embedding", wb, keep=["vec_id", "label"], head_col="round")
    return A.evaluate(R.score(lg, "logits", label="label"), by=["round"]).select(
        "round", r6("accuracy").alias("accuracy"), "n_correct", r6("mean_nll").alias("mean_nll"))


# ------------------------------------------- user functions (T7/U2, U3) and R8

@query("batched_map")
def q_batched_map(spark, sf_dir):
    """A batched row function over Arrow batches that keeps the input columns."""
    from pyspark.sql import types as T
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")

    def fn(pdf):
        return {"text_chars": pdf["text"].str.len().astype("int64"),
                "lang_upper": pdf["lang"].str.upper()}

    out = Tx.map_batches(docs, fn, [T.StructField("text_chars", T.LongType()),
                                    T.StructField("lang_upper", T.StringType())])
    return out.select("doc_id", "lang", "text_chars", "lang_upper")


def _fixed_head_scorer():
    """Scorer factory for ``score_with_fn``: called once per task."""
    w = fixed_head(NUM_CLASSES, WIDTH)

    def forward(feats):
        return np.asarray(feats["embedding"], dtype=float) @ w.T
    return forward


@query("score_user_fn")
def q_score_user_fn(spark, sf_dir):
    """A user forward function (features -> logits) run per Arrow batch."""
    emb = load(spark, sf_dir, "embeddings")
    lg = R.score_with_fn(emb, _fixed_head_scorer, ["embedding"], NUM_CLASSES, keep=["vec_id"])
    return R.score(lg, "logits").select("vec_id", "pred", r6("score").alias("score"))


@query("score_no_labels")
def q_score_no_labels(spark, sf_dir):
    """Scoring without labels: the output has no loss column."""
    s = _scored(spark, sf_dir, label=False)
    assert "nll" not in s.columns
    return s.select("vec_id", "pred", r6("score").alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


# ------------------------------------------------- written tables, read back (S)

def _shared(spark, name) -> str:
    """A new folder under the shared folder that the session names."""
    import os
    import uuid

    from hearth.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


@query("split_pair")
def q_split_pair(spark, sf_dir):
    """Training and validation tables of one schema, written and read as a pair."""
    from hearth.sources.sinks import write_table
    from hearth.sources.tables import read_pair
    docs, root = load(spark, sf_dir, "documents"), _shared(spark, "pair")
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    write_table(docs.filter(~held), f"{root}/train")
    write_table(docs.filter(held), f"{root}/validation")
    return read_pair(spark, f"{root}/train", f"{root}/validation", "documents").select("doc_id", "lang", "split")


@query("table_sink")
def q_table_sink(spark, sf_dir):
    """A table written in one folder per language, read back and counted."""
    from hearth.sources.sinks import write_table
    path = _shared(spark, "sink")
    write_table(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path, partition_by=["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query("metric_history")
def q_metric_history(spark, sf_dir):
    """Metrics of two runs appended to one history, read back."""
    from hearth.sources.sinks import append_metrics
    path = _shared(spark, "metrics")
    found = A.correct_total(_scored(spark, sf_dir))
    for run in ("first", "second"):
        append_metrics(found, path, run)
    append_metrics(found, path, "second")  # a retry replaces its run
    return spark.read.parquet(path).select("run", "n_correct", "n_total")


@query("head_reload")
def q_head_reload(spark, sf_dir):
    """Logits of a head that was saved and loaded again."""
    from hearth.sources.sinks import load_head, save_head
    path = _shared(spark, "head")
    save_head(spark, path, fixed_head(NUM_CLASSES, WIDTH))
    w, b = load_head(spark, path)
    lg = R.head_logits(load(spark, sf_dir, "embeddings"), "embedding", w, b)
    return lg.select("vec_id", F.posexplode_outer("logits").alias("class_id", "logit")) \
        .select("vec_id", "class_id", r6("logit").alias("logit"))


def _l2(vec: str):
    return r6(F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, v: a + v.cast("double") * v)))


@query("feature_reuse")
def q_feature_reuse(spark, sf_dir):
    """Features written once, then used from the written table."""
    import uuid

    from hearth.sources.sinks import materialise
    views = V.layer_views(load(spark, sf_dir, "embeddings"), "embedding", VIEW_WIDTH, N_VIEWS, keep=["vec_id"])
    kept = materialise(views, f"features-{uuid.uuid4().hex}")
    return kept.select("vec_id", F.col("view").cast("int").alias("view"), _l2("vec").alias("l2"))


@query("flatten_views")
def q_flatten_views(spark, sf_dir):
    """One row per inner vector of a nested column."""
    emb = load(spark, sf_dir, "embeddings")
    nested = F.array(*[F.slice("embedding", k * VIEW_WIDTH + 1, VIEW_WIDTH) for k in range(N_VIEWS)])
    rows = V.flatten_rows(emb.select("vec_id", nested.alias("views")), "views", "vec")
    return rows.select("vec_id", F.col("pos").cast("int").alias("pos"), _l2("vec").alias("l2"))

"""DuckDB oracle SQL, one statement per registered query.

Each statement runs on the same Parquet tables (registered as views named after
the tables). Column names and types are aligned with the Spark query; doubles are
rounded to 6 places on both sides.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


# ------------------------------------------------------------ scoring building blocks

def head_cte(name: str, round_: int = 0, classes: int = 10, width: int = 64,
             scale: str = "") -> str:
    """The fixed head rule as a (c, j, w) table."""
    return f"""{name} AS (
  SELECT c.range AS c, j.range AS j,
         ((((c.range * 31 + j.range * 17 + {round_} * 7) % 23) - 11) / 11.0::DOUBLE){scale} AS w
  FROM range({classes}) c, range({width}) j)"""


EMB_LONG = """emb_long AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
         generate_subscripts(embedding, 1) - 1 AS j
  FROM embeddings)"""

LOGITS = """logits AS (
  SELECT e.vec_id, e.label, h.c AS class_id, sum(e.v * h.w) AS z
  FROM emb_long e JOIN head h ON e.j = h.j
  GROUP BY e.vec_id, e.label, h.c)"""

SCORED = """scored AS (
  SELECT vec_id, label, m,
         min(class_id) FILTER (WHERE z = m)::INTEGER AS pred,
         sum(exp(z - m)) AS se,
         max(z) FILTER (WHERE class_id = label) AS z_label
  FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM logits) t
  GROUP BY vec_id, label, m)"""


def scoring_with(*extra: str, round_: int = 0) -> str:
    ctes = [EMB_LONG, head_cte("head", round_), LOGITS, SCORED, *extra]
    return "WITH " + ",\n".join(ctes) + "\n"


oracle("head_logits", scoring_with() + """
SELECT vec_id, class_id::INTEGER AS class_id, round(z, 6) AS logit FROM logits""")

oracle("project_chain", "WITH " + ",\n".join([
    EMB_LONG,
    head_cte("w1", 1, 64, 64, scale=" / 64.0"),
    head_cte("w2", 2, 10, 64),
    """hidden AS (
  SELECT e.vec_id, w1.c AS k, sum(e.v * w1.w) + 0.5 AS h
  FROM emb_long e JOIN w1 ON e.j = w1.j GROUP BY e.vec_id, w1.c)""",
]) + """
SELECT h.vec_id, w2.c::INTEGER AS class_id, round(sum(h.h * w2.w), 6) AS logit
FROM hidden h JOIN w2 ON h.k = w2.j GROUP BY h.vec_id, w2.c""")

oracle("predict_class", scoring_with() + "SELECT vec_id, label, pred FROM scored")

oracle("softmax", scoring_with() + """
SELECT l.vec_id, l.class_id::INTEGER AS class_id, round(exp(l.z - s.m) / s.se, 6) AS prob
FROM logits l JOIN scored s USING (vec_id)""")

oracle("predict_score", scoring_with() + """
SELECT vec_id, pred, round(1.0 / se, 6) AS score FROM scored""")

oracle("class_name", scoring_with() + """
SELECT vec_id, pred, 'class_' || pred::VARCHAR AS pred_name FROM scored""")

oracle("classify_struct", scoring_with() + """
SELECT vec_id, 'class_' || pred::VARCHAR AS result_label, round(1.0 / se, 6) AS result_score
FROM scored""")

oracle("score_table", scoring_with() + """
SELECT vec_id, label, pred, round(1.0 / se, 6) AS score,
       round(m + ln(se) - z_label, 6) AS nll
FROM scored""")

oracle("mean_cross_entropy", scoring_with() + """
SELECT round(avg(m + ln(se) - z_label) FILTER (WHERE label IS NOT NULL), 6) AS mean_nll,
       count(*) FILTER (WHERE label IS NOT NULL) AS n_labelled
FROM scored""")

oracle("accuracy", scoring_with() + """
SELECT round(avg(CASE WHEN label IS NULL THEN NULL ELSE (pred = label)::DOUBLE END), 6) AS accuracy,
       coalesce(sum(CASE WHEN label IS NULL THEN NULL ELSE (pred = label)::INTEGER END), 0)::BIGINT
         AS n_correct,
       count(*) FILTER (WHERE label IS NOT NULL) AS n_labelled,
       count(*) FILTER (WHERE label IS NULL) AS n_unlabelled,
       round(avg(m + ln(se) - z_label) FILTER (WHERE label IS NOT NULL), 6) AS mean_nll
FROM scored""")

oracle("correct_total", scoring_with() + """
SELECT coalesce(sum((pred = label)::INTEGER) FILTER (WHERE label IS NOT NULL), 0)::BIGINT AS n_correct,
       count(*) FILTER (WHERE label IS NOT NULL) AS n_total
FROM scored""")


def _round_scored(round_: int) -> str:
    return f"""
SELECT {round_}::INTEGER AS round, vec_id, label, pred, m + ln(se) - z_label AS nll
FROM (WITH {EMB_LONG}, {head_cte('head', round_)}, {LOGITS}, {SCORED} SELECT * FROM scored)"""


oracle("accuracy_by_round", f"""
WITH r AS ({' UNION ALL '.join(_round_scored(r) for r in (0, 1, 2))})
SELECT round,
       round(avg((pred = label)::DOUBLE) FILTER (WHERE label IS NOT NULL), 6) AS accuracy,
       coalesce(sum((pred = label)::INTEGER) FILTER (WHERE label IS NOT NULL), 0)::BIGINT AS n_correct,
       round(avg(nll) FILTER (WHERE label IS NOT NULL), 6) AS mean_nll
FROM r GROUP BY round""")

_TWO_ROUNDS = f"""
WITH a AS ({_round_scored(0)}), b AS ({_round_scored(1)}),
two AS (SELECT a.vec_id, a.pred AS old_pred, b.pred AS new_pred FROM a JOIN b USING (vec_id))
"""

oracle("compare_results", _TWO_ROUNDS + """
SELECT old_pred AS old_result, new_pred AS new_result, count(*) AS n_rows
FROM two GROUP BY old_pred, new_pred""")

oracle("compare_summary", _TWO_ROUNDS + """
SELECT count(*) AS n_rows, sum((old_pred = new_pred)::BIGINT)::BIGINT AS n_agree,
       round(avg((old_pred = new_pred)::DOUBLE), 6) AS agreement
FROM two""")


# ------------------------------------------------------------------ positional

DOC_COLS = "doc_id, lang, source, n_chars"

oracle("scan_documents", f"SELECT {DOC_COLS}, length(text)::INTEGER AS text_len FROM documents")
oracle("row_count", "SELECT count(*) AS n_rows FROM documents")
oracle("slice_head", f"SELECT {DOC_COLS} FROM documents ORDER BY doc_id LIMIT 160")
oracle("slice_range", f"SELECT {DOC_COLS} FROM documents ORDER BY doc_id LIMIT 40 OFFSET 160")
INDEX_KEYS = {
    "wide": "(1152921504606846976 + doc_id)::BIGINT",
    "decimal": "doc_id::DECIMAL(38,0) + 1000000000000000000000000000000::DECIMAL(38,0)",
    "date": "(DATE '2000-01-01' + doc_id::INTEGER)::DATE",
}
for _kind, _key in INDEX_KEYS.items():
    oracle(f"index_slice_{_kind}", f"""
SELECT doc_id, lang, ({_key})::VARCHAR AS k FROM documents ORDER BY {_key} LIMIT 40 OFFSET 160""")
    oracle(f"index_batch_{_kind}", f"""
SELECT doc_id, ((row_number() OVER (ORDER BY {_key}) - 1) // 32)::BIGINT AS batch_id FROM documents""")
oracle("index_slice_text", "SELECT page_id, url FROM pages ORDER BY encode(url), page_id LIMIT 40 OFFSET 160")
oracle("index_batch_text", """
SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 32)::BIGINT AS batch_id FROM documents""")
oracle("slice_range_indexed", f"SELECT {DOC_COLS} FROM documents ORDER BY doc_id LIMIT 40 OFFSET 160")
oracle("row_at", f"SELECT {DOC_COLS} FROM documents ORDER BY doc_id LIMIT 1 OFFSET 170")
oracle("split_positional", f"""
SELECT {DOC_COLS}, CASE WHEN pos < 160 THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) t
WHERE pos < 200""")
oracle("batch_summary", """
SELECT (pos // 64)::BIGINT AS batch_id, count(*) AS n_rows, min(doc_id) AS first_key,
       max(doc_id) AS last_key
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) t
GROUP BY pos // 64""")
oracle("batch_assign", """
SELECT doc_id, n_chars, pos::BIGINT AS pos, (pos // 64)::BIGINT AS batch_id
FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) t""")
oracle("first_batch", f"SELECT {DOC_COLS} FROM documents ORDER BY doc_id LIMIT 64")
# one file a table: DuckDB numbers the rows of a scan in file order
oracle("file_slice", f"""
SELECT {DOC_COLS} FROM (SELECT *, row_number() OVER () - 1 AS pos FROM documents) t WHERE pos >= 160 AND pos < 200""")
oracle("file_batches", """
SELECT (pos // 64)::BIGINT AS batch_id, count(*) AS n_rows, min(page_id) AS first_key, max(page_id) AS last_key
FROM (SELECT page_id, row_number() OVER () - 1 AS pos FROM pages) t GROUP BY pos // 64""")
oracle("file_split", """
SELECT CASE WHEN pos < 160 THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, min(event_id) AS first_key,
       max(event_id) AS last_key
FROM (SELECT event_id, row_number() OVER () - 1 AS pos FROM events) t WHERE pos < 200 GROUP BY 1""")
oracle("const_columns", "SELECT doc_id, lang, '' AS new_result, 0.0::DOUBLE AS new_score FROM documents")
oracle("label_swap", """
SELECT doc_id, quality,
       CASE WHEN quality IN (0, 1) THEN 1 - quality ELSE quality END::INTEGER AS label
FROM labels""")
oracle("record_assembly", """
SELECT d.doc_id AS idx, d.text AS sentence,
       CASE WHEN l.quality IN (0, 1) THEN 1 - l.quality ELSE l.quality END::INTEGER AS labels
FROM documents d JOIN labels l USING (doc_id)""")
oracle("score_writeback", scoring_with() + """
SELECT e.vec_id, e.label, coalesce('class_' || s.pred::VARCHAR, '') AS new_result,
       round(coalesce(1.0 / s.se, 0.0), 6) AS new_score
FROM embeddings e LEFT JOIN scored s USING (vec_id)""")


# --------------------------------------------------------------------- encoder

TOKS = r"""toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS t
  FROM documents)"""
VOCAB_CTE = """counts AS (
  SELECT tok AS token, count(*) AS n FROM (SELECT unnest(t) AS tok FROM toks) u GROUP BY tok),
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token ASC) + 3)::INTEGER AS id, n
  FROM counts ORDER BY n DESC, token ASC LIMIT 1000)"""
ENCODED = """kept AS (SELECT doc_id, len(t)::INTEGER AS n_tokens, t[1:126] AS k FROM toks),
ex AS (SELECT doc_id, unnest(k) AS tok, generate_subscripts(k, 1) AS pos FROM kept),
ids AS (
  SELECT ex.doc_id, list(coalesce(v.id, 1) ORDER BY ex.pos) AS ids
  FROM ex LEFT JOIN vocab v ON ex.tok = v.token GROUP BY ex.doc_id),
enc AS (
  SELECT kept.doc_id, kept.n_tokens, coalesce(len(ids.ids), 0) AS n,
         list_resize([2] || coalesce(ids.ids, []::INTEGER[]) || [3], 128, 0) AS input_ids
  FROM kept LEFT JOIN ids USING (doc_id))"""

oracle("token_counts", f"WITH {TOKS} SELECT doc_id, len(t)::INTEGER AS n_tokens FROM toks")
oracle("vocab_top", f"WITH {TOKS}, {VOCAB_CTE} SELECT token, id, n FROM vocab")
oracle("encode_ids", f"""WITH {TOKS}, {VOCAB_CTE}, {ENCODED}
SELECT doc_id, n_tokens, len(input_ids)::INTEGER AS length,
       array_to_string(input_ids, ' ') AS input_ids FROM enc""")
oracle("attention_mask", f"""WITH {TOKS}, {VOCAB_CTE}, {ENCODED}
SELECT doc_id, (n + 2)::INTEGER AS mask_sum,
       array_to_string(list_resize(list_transform(range(n + 2), lambda i: 1), 128, 0), ' ')
         AS attention_mask FROM enc""")
oracle("encoded_reuse", f"""WITH {TOKS}, {VOCAB_CTE}, {ENCODED}
SELECT doc_id, n_tokens, (n + 2)::INTEGER AS mask_sum, len(input_ids)::INTEGER AS length,
       list_sum(input_ids)::BIGINT AS id_sum FROM enc""")
oracle("truncation_report", f"""WITH {TOKS}
SELECT doc_id, len(t)::INTEGER AS n_tokens, least(len(t), 126)::INTEGER AS n_kept,
       len(t) > 126 AS truncated FROM toks""")
oracle("empty_input_guard", f"""WITH {TOKS}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE len(t) = 0) AS n_empty FROM toks""")


# -------------------------------------------------------------- flags and keys

ANY = "(contains(source, 'src1') OR contains(source, 'src5'))"
HOSTS = """hosts AS (
  SELECT page_id, url,
         split_part(replace(replace(replace(url, 'https://', ''), 'http://', ''), 'www.', ''), '/', 1)
           AS key
  FROM pages)"""
SNAPSHOTS = HOSTS + """,
base AS (SELECT key, arg_max(url, page_id) AS url, max(page_id) AS page_id
         FROM hosts WHERE page_id % 2 = 0 GROUP BY key),
upd AS (SELECT key, arg_max(url, page_id) AS url, max(page_id) AS page_id
        FROM hosts WHERE page_id % 2 <> 0 GROUP BY key)"""

oracle("flag_any_substring", f"SELECT doc_id, source, coalesce({ANY}, false) AS flag FROM documents")
oracle("flag_additive", f"""
SELECT doc_id, lang, source, coalesce(lang = 'en', false) OR coalesce({ANY}, false) AS flag
FROM documents""")
oracle("flag_inverse", f"SELECT doc_id, source, NOT coalesce({ANY}, false) AS flag FROM documents")
oracle("list_flagged", f"SELECT doc_id FROM documents WHERE {ANY}")
oracle("pattern_report", """
SELECT p.pattern, count(d.doc_id) AS n_matched
FROM (VALUES ('src1'), ('src5'), ('src99'), ('SRC1')) p(pattern)
LEFT JOIN documents d ON contains(d.source, p.pattern)
GROUP BY p.pattern""")
oracle("match_suffix", f"""WITH {HOSTS}
SELECT page_id, key, (key = 'example.org' OR ends_with(key, '.example.org')) AS matched FROM hosts""")
oracle("target_report", f"""WITH {HOSTS}
SELECT t.pattern, count(h.page_id) AS n_matched
FROM (VALUES ('example.org'), ('example.com'), ('example')) t(pattern)
LEFT JOIN hosts h ON (h.key = t.pattern OR ends_with(h.key, '.' || t.pattern))
GROUP BY t.pattern""")
oracle("key_normalise", f"""WITH {HOSTS}
SELECT page_id, replace(replace(replace(url, 'https://', ''), 'http://', ''), 'www.', '') AS stripped,
       key FROM hosts""")
oracle("last_write_wins", f"""WITH {HOSTS}
SELECT key, arg_max(url, page_id) AS url, max(page_id) AS page_id FROM hosts GROUP BY key""")
oracle("snapshot_overlay", f"""WITH {SNAPSHOTS}
SELECT b.key, coalesce(u.url, b.url) AS url, u.key IS NOT NULL AS from_update
FROM base b LEFT JOIN upd u USING (key)""")
LETTERS = "(SELECT chr(97 + range::INTEGER) AS c FROM range(26))"
oracle("flag_any_many", f"""
SELECT doc_id, coalesce(bool_or(contains(text, p.pattern)), false) AS flag
FROM documents CROSS JOIN (SELECT s || c AS pattern FROM (VALUES ('qu'), ('zz'), ('Xy')) v(s), {LETTERS}) p GROUP BY doc_id""")
oracle("pattern_report_many", f"""
SELECT p.pattern, count(d.doc_id) AS n_matched
FROM (SELECT a.c || b.c AS pattern FROM {LETTERS} a, {LETTERS} b) p
LEFT JOIN documents d ON contains(d.text, p.pattern) GROUP BY p.pattern""")
MANY_TARGETS = """targets AS (
  SELECT 'site' || range || '.example.org' AS target FROM range(500)
  UNION ALL SELECT unnest(['example.org', 'example.com', 'example', 'org', 'com']))"""
oracle("match_targets_many", f"""WITH {HOSTS}, {MANY_TARGETS}
SELECT page_id, target FROM hosts JOIN targets ON key = target OR ends_with(key, '.' || target)""")
oracle("target_report_many", f"""WITH {HOSTS}, {MANY_TARGETS}
SELECT target AS pattern, count(page_id) AS n_matched
FROM targets LEFT JOIN hosts ON key = target OR ends_with(key, '.' || target) GROUP BY target""")
CHAIN_AS_OF = """SELECT key, arg_max(url, v) AS url, max(v)::BIGINT AS changed{extra} FROM (
  SELECT key, page_id % 5 AS v, arg_max(url, page_id) AS url FROM hosts WHERE page_id % 5 <= {upto} GROUP BY key, v) t
GROUP BY key HAVING min(v) = 0"""
oracle("snapshot_chain", f"""WITH {HOSTS}
{CHAIN_AS_OF.format(upto=2, extra=", 2 AS version")} UNION ALL {CHAIN_AS_OF.format(upto=4, extra=", 4 AS version")}""")
oracle("snapshot_compacted", f"WITH {HOSTS} {CHAIN_AS_OF.format(upto=4, extra='')}")
oracle("key_drift", f"""WITH {SNAPSHOTS}
SELECT key, 'missing' AS status FROM base WHERE key NOT IN (SELECT key FROM upd)
UNION ALL
SELECT key, 'unexpected' AS status FROM upd WHERE key NOT IN (SELECT key FROM base)""")
oracle("flagged_share", f"""
SELECT coalesce(sum(CASE WHEN {ANY} THEN n_chars ELSE 0 END), 0)::BIGINT AS n_flagged,
       coalesce(sum(n_chars), 0)::BIGINT AS n_total,
       round(sum(CASE WHEN {ANY} THEN n_chars ELSE 0 END) / sum(n_chars), 6) AS share
FROM documents""")


# --------------------------------------------------------------------- vectors

oracle("view_pick", f"""WITH {EMB_LONG}
SELECT vec_id, (j - 16)::INTEGER AS j, round(v, 6) AS v FROM emb_long WHERE j BETWEEN 16 AND 31""")
oracle("layer_views", f"""WITH {EMB_LONG}
SELECT vec_id, (j // 16 + 1)::INTEGER AS view, round(sqrt(sum(v * v)), 6) AS l2,
       round(arg_min(v, j), 6) AS first
FROM emb_long GROUP BY vec_id, j // 16""")
oracle("pool_first", """
SELECT conv_id, arg_min(text, turn) AS first_text, min(turn) AS first_turn
FROM conversations GROUP BY conv_id""")
oracle("project_wide", "WITH " + ",\n".join([EMB_LONG, head_cte("head", 3, 72, 64, scale=" / 8.0")]) + """
SELECT e.vec_id, h.c::INTEGER AS k, round(sum(e.v * h.w), 6) AS y
FROM emb_long e JOIN head h ON e.j = h.j GROUP BY e.vec_id, h.c""")
oracle("vec_sum", f"""WITH {EMB_LONG}
SELECT vec_id, (j % 16)::INTEGER AS j, round(sum(v), 6) AS v FROM emb_long GROUP BY vec_id, j % 16""")
oracle("vec_concat", f"""WITH {EMB_LONG}
SELECT vec_id, (CASE WHEN j >= 48 THEN j - 48 ELSE j + 16 END)::INTEGER AS j, round(v, 6) AS v
FROM emb_long WHERE j >= 48 OR j < 16""")
oracle("one_hot", """
SELECT vec_id, label,
       array_to_string(list_transform(range(10), lambda c: coalesce((c = label)::INTEGER, 0)), ' ')
         AS one_hot
FROM embeddings""")
oracle("shape_profile", """
SELECT 'embedding' AS column_name, count(*) AS n_rows,
       count(*) FILTER (WHERE embedding IS NULL) AS n_null,
       min(len(embedding))::INTEGER AS min_len, max(len(embedding))::INTEGER AS max_len
FROM embeddings""")

# ------------------------------------------------------------------ head fitting
# Only the Gram sums are SQL-expressible; the solves (pseudo-inverse, iterative
# logistic regression) have no oracle and are checked by row count and by the
# unit tests against numpy.

oracle("gram_matrix", f"""WITH {EMB_LONG},
lab AS (SELECT * FROM emb_long WHERE label IS NOT NULL),
xx AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS value
       FROM lab a JOIN lab b ON a.vec_id = b.vec_id GROUP BY a.j, b.j),
xy AS (SELECT j AS i, label AS c, sum(v) AS value FROM lab GROUP BY j, label)
SELECT i::INTEGER AS i, j::INTEGER AS j, round(value, 6) AS value FROM xx
UNION ALL
SELECT i.range::INTEGER AS i, (64 + c.range)::INTEGER AS j, round(coalesce(xy.value, 0.0), 6) AS value
FROM range(64) i CROSS JOIN range(10) c LEFT JOIN xy ON xy.i = i.range AND xy.c = c.range""")


# ---------------------------------------------------------------- closed-form heads

RANKED = """ranked AS (
  SELECT vec_id, label, embedding,
         row_number() OVER (ORDER BY vec_id) <= floor(0.8 * count(*) OVER ()) AS is_train
  FROM embeddings),
raw AS (
  SELECT vec_id, label, is_train, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j
  FROM ranked)"""


def gauss_jordan(name: str, cells: str, d: int) -> str:
    """Eliminates the first ``d`` columns of ``cells(grp, i, j, v)`` in ``d`` steps, for every group."""
    return f"""{name}(grp, k, i, j, v) AS (
  SELECT grp, 0, i, j, v FROM {cells}
  UNION ALL
  SELECT a.grp, a.k + 1, a.i, a.j, CASE WHEN a.i = a.k THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END
  FROM {name} a
  JOIN {name} p ON p.grp = a.grp AND p.i = a.k AND p.j = a.k
  JOIN {name} r ON r.grp = a.grp AND r.i = a.k AND r.j = a.j
  JOIN {name} c ON c.grp = a.grp AND c.i = a.i AND c.j = a.k
  WHERE a.k < {d})"""


def closed_form(feats: str, d: int) -> str:
    """``feats`` selects ``(grp, vec_id, label, is_train, j, v)``; gives ``head`` and ``scored`` (held-out rows)."""
    return f"""WITH RECURSIVE {RANKED},
feats AS ({feats}),
x AS (SELECT * FROM feats WHERE is_train AND label IS NOT NULL),
cells AS (
  SELECT a.grp, a.j AS i, b.j AS j, sum(a.v * b.v) AS v
  FROM x a JOIN x b ON a.grp = b.grp AND a.vec_id = b.vec_id GROUP BY a.grp, a.j, b.j
  UNION ALL
  SELECT grp, j, {d} + c.range, sum(CASE WHEN label = c.range THEN v ELSE 0.0 END)
  FROM x CROSS JOIN range(10) c GROUP BY grp, j, c.range),
{gauss_jordan("solved", "cells", d)},
head AS (SELECT grp, j - {d} AS c, i AS j, v AS w FROM solved WHERE k = {d} AND j >= {d}),
logits AS (
  SELECT e.grp, e.vec_id, e.label, h.c AS class_id, sum(e.v * h.w) AS z
  FROM feats e JOIN head h ON e.grp = h.grp AND e.j = h.j WHERE NOT e.is_train
  GROUP BY e.grp, e.vec_id, e.label, h.c),
scored AS (
  SELECT grp, vec_id, label, min(class_id) FILTER (WHERE z = m)::INTEGER AS pred, 1.0 / sum(exp(z - m)) AS score
  FROM (SELECT *, max(z) OVER (PARTITION BY grp, vec_id) AS m FROM logits) t GROUP BY grp, vec_id, label)
"""


WHOLE = "SELECT 1 AS grp, * FROM raw"
HITS = """round(avg((pred = label)::DOUBLE) FILTER (WHERE label IS NOT NULL), 6) AS accuracy,
       coalesce(sum((pred = label)::INTEGER) FILTER (WHERE label IS NOT NULL), 0)::BIGINT AS n_correct,
       count(*) FILTER (WHERE label IS NOT NULL) AS n_labelled"""

oracle("lstsq_fit", closed_form(WHOLE, 64) + """
SELECT c::INTEGER AS class_id, j::INTEGER AS j, round(w, 6) AS w FROM head""")
# an optimum: every listed move of one weight raises the loss over the rows it was fitted on
oracle("head_fit_optimum", """
WITH train AS (SELECT label, row_number() OVER (ORDER BY vec_id) <= floor(0.8 * count(*) OVER ()) AS is_train FROM embeddings)
SELECT c.range::INTEGER AS class, f.feature, s.sign, (SELECT count(label) FROM train WHERE is_train) AS n_rows, true AS higher
FROM range(10) c, (VALUES (0), (21), (42), (63)) f(feature), (VALUES (1), (-1)) s(sign)""")
oracle("lstsq_eval", closed_form(WHOLE, 64) + """
SELECT vec_id, label, pred, round(score, 6) AS score FROM scored""")
oracle("head_per_view", closed_form(
    "SELECT j // 16 + 1 AS grp, vec_id, label, is_train, j % 16 AS j, v FROM raw", 16) + f"""
SELECT grp::INTEGER AS view, {HITS} FROM scored GROUP BY grp""")
oracle("fused_head", closed_form("""
  SELECT 1 AS grp, vec_id, label, is_train, m.range AS j,
         sum(v * ((((m.range * 31 + (raw.j % 16) * 17 + (5 + raw.j // 16) * 7) % 23) - 11) / 11.0::DOUBLE) / 4.0) AS v
  FROM raw CROSS JOIN range(16) m WHERE raw.j < 48 GROUP BY vec_id, label, is_train, m.range
  UNION ALL
  SELECT 1, vec_id, label, is_train, j - 32, v FROM raw WHERE j >= 48""", 32) + f"""
SELECT {HITS} FROM scored""")


def _rounds_sql(steps: tuple[int, ...], reg: float = 1e-3) -> str:
    """The continued rounds, one chain of common table expressions per step."""
    parts = [f"""WITH RECURSIVE {RANKED},
x AS (SELECT vec_id, label, is_train, j, v FROM raw
      UNION ALL SELECT vec_id, label, is_train, 64, 1.0 FROM ranked),
t AS MATERIALIZED (SELECT * FROM x WHERE is_train AND label IS NOT NULL),
n AS (SELECT count(DISTINCT vec_id) AS n FROM t),
cells AS (
  SELECT 1 AS grp, a.j AS i, b.j AS j,
         0.5 * sum(a.v * b.v) / any_value(n.n) + CASE WHEN a.j = b.j THEN {reg}::DOUBLE ELSE 0.0 END AS v
  FROM t a JOIN t b ON a.vec_id = b.vec_id CROSS JOIN n GROUP BY a.j, b.j
  UNION ALL
  SELECT 1, i.range, 65 + j.range, CASE WHEN i.range = j.range THEN 1.0 ELSE 0.0 END FROM range(65) i, range(65) j),
{gauss_jordan("solved", "cells", 65)},
bound AS MATERIALIZED (SELECT i, j - 65 AS j, v FROM solved WHERE k = 65 AND j >= 65),
w0 AS (SELECT c.range AS c, j.range AS j, 0.0::DOUBLE AS w FROM range(10) c, range(65) j)"""]
    for s in range(sum(steps)):
        parts.append(f"""z{s} AS (SELECT vec_id, label, c, sum(v * w) AS z FROM t JOIN w{s} USING (j) GROUP BY vec_id, label, c),
e{s} AS (SELECT vec_id, c, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY vec_id) - (label = c)::INTEGER AS r
  FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z{s}) q),
g{s} AS (SELECT c, j, sum(r * v) / any_value(n.n) AS g FROM e{s} JOIN t USING (vec_id) CROSS JOIN n GROUP BY c, j),
d{s} AS (SELECT c, j, g + {reg}::DOUBLE * w AS g FROM g{s} JOIN w{s} USING (c, j)),
w{s + 1} AS MATERIALIZED (
  SELECT w{s}.c, w{s}.j, any_value(w{s}.w) - sum(d{s}.g * bound.v) AS w
  FROM w{s} JOIN d{s} ON d{s}.c = w{s}.c JOIN bound ON bound.i = d{s}.j AND bound.j = w{s}.j GROUP BY w{s}.c, w{s}.j)""")
    ends = [sum(steps[:k + 1]) for k in range(len(steps))]
    parts.append("heads AS (" + " UNION ALL ".join(f"SELECT {r} AS round, * FROM w{e}" for r, e in enumerate(ends)) + ")")
    parts.append("""logits AS (SELECT round, vec_id, label, c, sum(v * w) AS z
  FROM x JOIN heads USING (j) WHERE NOT is_train GROUP BY round, vec_id, label, c),
scored AS (
  SELECT round, vec_id, label, min(c) FILTER (WHERE z = m) AS pred,
         ln(sum(exp(z - m))) + any_value(m) - max(z) FILTER (WHERE c = label) AS nll
  FROM (SELECT *, max(z) OVER (PARTITION BY round, vec_id) AS m FROM logits) q GROUP BY round, vec_id, label)""")
    return ",\n".join(parts) + """
SELECT round::INTEGER AS round, round(avg((pred = label)::DOUBLE) FILTER (WHERE label IS NOT NULL), 6) AS accuracy,
       coalesce(sum((pred = label)::INTEGER) FILTER (WHERE label IS NOT NULL), 0)::BIGINT AS n_correct,
       round(avg(nll) FILTER (WHERE label IS NOT NULL), 6) AS mean_nll
FROM scored GROUP BY scored.round"""


oracle("fit_rounds", _rounds_sql((1, 3, 10)))


# ------------------------------------------------------------ user functions

oracle("batched_map", """
SELECT doc_id, lang, length(text)::BIGINT AS text_chars, upper(lang) AS lang_upper FROM documents""")
oracle("score_user_fn", scoring_with() + "SELECT vec_id, pred, round(1.0 / se, 6) AS score FROM scored")
oracle("score_no_labels", scoring_with() + "SELECT vec_id, pred, round(1.0 / se, 6) AS score FROM scored")


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ------------------------------------------------- written tables, read back

oracle("split_pair", """
SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents""")
oracle("table_sink", """
SELECT lang, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang""")
oracle("metric_history", scoring_with() + """
SELECT run, coalesce(sum((pred = label)::INTEGER) FILTER (WHERE label IS NOT NULL), 0)::BIGINT AS n_correct,
       count(*) FILTER (WHERE label IS NOT NULL) AS n_total
FROM scored, (VALUES ('first'), ('second')) r(run) GROUP BY run""")
oracle("head_reload", scoring_with() + """
SELECT vec_id, class_id::INTEGER AS class_id, round(z, 6) AS logit FROM logits""")
oracle("feature_reuse", f"""WITH {EMB_LONG}
SELECT vec_id, (j // 16 + 1)::INTEGER AS view, round(sqrt(sum(v * v)), 6) AS l2 FROM emb_long GROUP BY vec_id, j // 16""")
oracle("flatten_views", f"""WITH {EMB_LONG}
SELECT vec_id, (j // 16)::INTEGER AS pos, round(sqrt(sum(v * v)), 6) AS l2 FROM emb_long GROUP BY vec_id, j // 16""")

"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from hearth.llm.chat import END, TEXT, TURN
from hearth.llm.lattice import COSINE
from hearth.llm.licences import PHRASES, TEMPLATES, THRESHOLD, span
from hearth.llm.mixing import MAX_EPOCHS, SHARE, WEIGHTS


def op1() -> str:
    return rf"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
               FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)}) + 1] AS weight,
                 {MAX_EPOCHS} * source_size AS cap FROM s),
    l AS (SELECT *, ({SHARE[0]} * sum(source_size) OVER ()
                     - {SHARE[1]} * coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                  / ({SHARE[1]} * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
    t AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target FROM l),
    r AS (SELECT d.*, t.source_size, t.target,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '')), d.size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM r)
    SELECT doc_id, size, source_size, target,
           size * least(whole + CASE WHEN 2 * start + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END,
                        {MAX_EPOCHS})::BIGINT AS taken
    FROM e"""


def op6() -> str:
    chars = r"0-9A-Za-z\x{80}-\x{10FFFF}"
    words = f"[{chars}]+"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split()!r}, '{x}')" for p, x in PHRASES.items())
    templates = ", ".join(f"({k}, '{x}', {sorted(set(t.split()))!r}, {span(t)})" for k, (x, t) in enumerate(TEMPLATES))
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, regexp_extract_all({low.format('text')}, '{words}') AS ws FROM d),
    p(ph, label) AS (VALUES {phrases}),
    u AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i, ws FROM w),
    hits AS (SELECT u.r, u.i, p.label FROM u JOIN p ON u.w = p.ph[1] AND u.ws[u.i + 1:u.i + len(p.ph)] = p.ph),
    base AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS labels FROM hits GROUP BY r),
    t(k, label, words, wide) AS (VALUES {templates}),
    met AS (SELECT r, label, max(len(list_intersect(ws[i + 1:i + wide], words))) / len(words)::DOUBLE AS score
            FROM u JOIN t ON list_contains(words, w) GROUP BY r, k, label, words, wide
            HAVING max(len(list_intersect(ws[i + 1:i + wide], words))) >= ceil({THRESHOLD} * len(words) - 1e-9)),
    more AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM met GROUP BY r)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.first::BIGINT AS first_word,
           base.last::BIGINT AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
           CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(more.score, 0.0) END::DOUBLE AS score
    FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)"""


def op8() -> str:
    return f"""
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    ok AS (SELECT r, vec_id, x, sqrt(list_sum([y * y for y in x])) AS norm FROM v
           WHERE x IS NOT NULL AND len([y for y in x if y IS NULL OR isnan(y) OR isinf(y)]) = 0
             AND list_sum([y * y for y in x]) > 0),
    links AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM ok a JOIN ok b
              ON a.r <> b.r AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {COSINE}),
    reach(r, id) AS (SELECT r, vec_id FROM v UNION SELECT links.a, reach.id FROM reach JOIN links ON reach.r = links.b),
    low AS (SELECT r, min(id) AS component_id FROM reach GROUP BY r),
    n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
    SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, low.component_id, v.vec_id = low.component_id AS kept
    FROM v JOIN low USING (r) LEFT JOIN n USING (r)"""


def op10() -> str:
    marks = len(TURN) + len(TEXT) + len(END)
    esc = "{}"
    for a, b in (("\\", "\\\\"), ("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]")):
        esc = f"replace({esc}, '{a}', '{b}')"
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
               UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum({marks} + length({esc.format('role')}) + length({esc.format('text')}))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id"""


def op13() -> str:
    # CRC-32 of a decimal number, bit by bit (fixed value: its reflected polynomial)
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(substr(c::VARCHAR, i, 1))::BIGINT
                 for i in range(1, length(c::VARCHAR) + 1)]),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                      lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
    return rf"""
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
                      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    h AS (SELECT c, c - c % 20 AS base, {crc} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
    m AS (SELECT h.c, t.p, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.p <= h.h
          UNION ALL SELECT t.c, t.p, t.role, t.text FROM t JOIN h ON t.c = h.c AND t.p > h.h),
    d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, md5(length(role) || ':' || role || text) AS k,
                 coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS w FROM m),
    pre AS (SELECT c, d, w, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM d
            UNION ALL SELECT c, 0, 0, '' FROM h),
    nodes AS (SELECT key, d, min(c) AS c, count(*) AS n, any_value(w) AS w FROM pre GROUP BY key, d),
    up AS (SELECT DISTINCT a.key, b.key AS parent FROM pre a JOIN pre b ON a.c = b.c AND b.d = a.d - 1),
    kids AS (SELECT parent AS key, count(*) AS n FROM up GROUP BY parent),
    ends AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha
             FROM (SELECT c, max(d) AS d FROM pre GROUP BY c) JOIN pre USING (c, d) GROUP BY key),
    under AS (SELECT DISTINCT b.key AS top, a.key FROM pre a JOIN pre b ON a.c = b.c AND b.d <= a.d),
    sums AS (SELECT top AS key, sum((nodes.n - 1) * nodes.w) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
             FROM under JOIN nodes USING (key) LEFT JOIN kids USING (key) GROUP BY top)
    SELECT nodes.c::BIGINT AS conv_id, nodes.d::BIGINT AS depth, p.c::BIGINT AS parent_conv_id, nodes.n::BIGINT AS n_convs,
           coalesce(kids.n, 0)::BIGINT AS n_children, sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens,
           coalesce(ends.sha, sha256('')) AS ends_sha256
    FROM nodes JOIN sums USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key)
    LEFT JOIN up USING (key) LEFT JOIN nodes p ON p.key = up.parent"""


ORACLES = {"op1_mixing": op1(), "op6_licences": op6(), "op8_embeddings": op8(), "op10_chat": op10(), "op13_prefix_trie": op13()}

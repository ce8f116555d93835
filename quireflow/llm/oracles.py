"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

# words as the contracts define them
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(i, i + 20)) AS t(p)),
per AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(list_transform(w, lambda x, k: CASE WHEN list_contains(ps, k) THEN NULL ELSE x END), lambda x: x IS NOT NULL), ' ') END) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, order: int, rx: str, group: int, least: int) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, {order} AS o, {least} AS least, regexp_extract_all(text, '{rx}', 0) AS m, regexp_extract_all(text, '{rx}', {group}) AS g, string_split_regex(text, '{rx}') AS p FROM d"


OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({_matches("assign", 1, _ASSIGN, 2, 6)} UNION ALL {_matches("access", 2, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_matches("hex", 3, "[0-9a-f]+", 0, 24)}),
u AS (SELECT doc_id, kind, o, least, i, len(p[i]) AS gap, len(m[i]) AS n, len(g[i]) AS part FROM k, unnest(range(1, len(m) + 1)) AS t(i)),
s AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS fin FROM u),
f AS (SELECT doc_id, kind, o, CAST(fin - n AS BIGINT) AS st, CAST(fin AS BIGINT) AS fin FROM s WHERE part >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || st || ':' || fin, ',' ORDER BY st, o) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM d, unnest(range(1, len(w) - 2)) AS t(i)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM meet JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 100 * x >= 80 * (p.n + q.n - x)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c, d.doc_id)) AS kept
FROM d LEFT JOIN sz USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(c, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c, v.vec_id)) AS kept
FROM v LEFT JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)
"""

OP3 = r"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
pr AS (SELECT conv_id >> 1 AS k, max(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (conv_id % 2 = 1) AS rejected_id FROM t GROUP BY 1),
sz AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
al AS (SELECT pr.k, c.i, (c.role = r.role AND c.text = r.text) AS same FROM pr JOIN t c ON c.conv_id = chosen_id JOIN t r ON r.conv_id = rejected_id AND r.i = c.i),
pl AS (SELECT pr.k, chosen_id, rejected_id, coalesce(min(al.i) FILTER (NOT same) - 1, least(coalesce(any_value(a.n), 0), coalesce(any_value(b.n), 0))) AS n
  FROM pr LEFT JOIN al USING (k) LEFT JOIN sz a ON a.conv_id = chosen_id LEFT JOIN sz b ON b.conv_id = rejected_id GROUP BY 1, 2, 3),
rest AS (SELECT k, 'c' AS side, i, role, text FROM pl JOIN t ON conv_id = chosen_id WHERE i > n UNION ALL SELECT k, 'r', i, role, text FROM pl JOIN t ON conv_id = rejected_id WHERE i > n),
shown AS (SELECT k, side, i, role AS plain, replace(role, '|', '¦') AS role, replace(text, '<|', '<||') AS text FROM rest),
pos AS (SELECT *, sum(len(role) + len(text) + 6) OVER (PARTITION BY k, side ORDER BY i) - 1 AS fin FROM shown),
done AS (SELECT k, side, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY i) AS s,
  string_agg(CAST(fin - len(text) AS BIGINT) || ':' || CAST(fin AS BIGINT), ',' ORDER BY i) FILTER (plain = 'assistant') AS m FROM pos GROUP BY 1, 2),
prompt AS (SELECT k, string_agg('<|' || replace(role, '|', '¦') || '|>' || chr(10) || replace(text, '<|', '<||') || chr(10), '' ORDER BY i) AS s FROM pl JOIN t ON conv_id = chosen_id WHERE i <= n GROUP BY k)
SELECT chosen_id, rejected_id, CAST(n AS BIGINT) AS n_prompt_turns, coalesce(p.s, '') AS prompt, coalesce(c.s, '') AS chosen, coalesce(r.s, '') AS rejected,
       coalesce(c.m, '') AS chosen_mask, coalesce(r.m, '') AS rejected_mask
FROM pl LEFT JOIN prompt p USING (k) LEFT JOIN done c ON c.k = pl.k AND c.side = 'c' LEFT JOIN done r ON r.k = pl.k AND r.side = 'r'
"""

ORACLES = {"op1_substring_dedup": OP1, "op3_chat_formatting": OP3, "op4_secret_scans": OP4, "op5_embedding_dedup": OP5, "op6_minhash_dedup": OP6}

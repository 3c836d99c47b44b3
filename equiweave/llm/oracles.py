"""DuckDB SQL with the same rows as the corpus queries, where SQL can express them.

Op 1 and 2 draw by hashes of this engine, 4 and 6 are trained, 8 is a merge loop: these are held
against brute force, an exact round trip or held-out labels in tests/llm.
"""

from __future__ import annotations

from equiweave.llm.chat import BREAK, CLOSE, CONTROLS, OPEN

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, x, encode(x) AS b, lower(sha1(x)) AS h FROM p),
g AS (SELECT *, count(*) OVER (PARTITION BY x) AS n, max(page_id) OVER (PARTITION BY x) AS last FROM d),
bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), 'string_agg', '') AS s FROM g)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(s, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(s, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(s, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(s, 5 * i + 4, 1) AS INT) + CAST(substr(s, 5 * i + 5, 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN n > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM bits
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT doc_id, hash(g) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP9 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
lw AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l) AS k FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
ld AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k > 1) AS dups,
    count(*) FILTER (WHERE len(l) - len(replace(l, '|', '')) >= 5) AS tables FROM lw GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: list_slice(w, i, i + 7))) AS g FROM w WHERE len(w) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT i + o) AS repeated FROM h, (SELECT unnest(range(0, 8)) AS o) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT w.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(t) - len(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(tables, 0) AS tables,
    len(t) - len(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper, len(t) - len(regexp_replace(t, '\p{{L}}', '', 'g')) AS alpha
  FROM w LEFT JOIN ld USING (doc_id) LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words)
    OR 10 * upper > 7 * alpha OR (n_lines > 0 AND 2 * tables >= n_lines)) AS kept
FROM f
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _breaks(column: str) -> str:
    """Characters that escaping adds: one for each backslash and each control string."""
    counts = [f"(len({column}) - len(replace({column}, {_quoted(c)}, ''))) // {len(c)}" for c in CONTROLS]
    return f"len({column}) - len(replace({column}, chr(92), '')) + " + " + ".join(counts)


OP10 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, {len(OPEN + BREAK + CLOSE)} + len(role) + {_breaks("role")} + len(role) - len(replace(role, chr(10), '')) + len(text) + {_breaks("text")} AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op3_warc": OP3, "op5_topk": OP5, "op7_minhash": OP7, "op9_rules": OP9, "op10_chat": OP10}

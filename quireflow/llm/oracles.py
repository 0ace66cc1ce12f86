"""DuckDB SQL for the results of this subpackage's queries, written apart from the operators' own logic."""

from __future__ import annotations

from quireflow.llm.lines import MIN_CHARS
from quireflow.llm.preferences import PARTS

_BITS = "', '".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
WARC = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT p.*, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes,
  list_reduce(flatten(list_transform(range(8), lambda g: list_transform(range(4), lambda k:
    list_extract(['{_BITS}'], 1 + (('0x' || substr(hex, (5 * g + 1)::INT, 5))::INT >> (15 - 5 * k)::INT) % 32)))), lambda a, b: a || b) AS payload_digest,
  CASE WHEN least IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN least IS DISTINCT FROM page_id THEN least END AS refers_to
FROM d
"""

# All variants of all lines, with none of the operator's filter by halves.
LINES = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
v AS (SELECT line, min((doc_id, no)) AS pos FROM l WHERE trim(line) <> '' GROUP BY line),
f AS (SELECT line, pos, length(line) AS n FROM v WHERE length(line) >= {MIN_CHARS}),
c AS (SELECT line, pos, i, md5(substr(line, 1, (i - 1)::INT) || substr(line, (i + 1)::INT)) AS cut FROM (SELECT line, pos, unnest(range(1, n + 1)) AS i FROM f)),
w AS (SELECT line, pos, md5(line) AS cut FROM f),
beaten AS (
  SELECT line FROM (SELECT line, pos, min(pos) OVER (PARTITION BY cut, i) AS first FROM c) WHERE first < pos
  UNION SELECT c.line FROM c JOIN w USING (cut) WHERE w.pos < c.pos
  UNION SELECT w.line FROM c JOIN w USING (cut) WHERE c.pos < w.pos),
k AS (
  SELECT l.doc_id, l.no, l.line, (trim(l.line) = '' OR (v.pos = (l.doc_id, l.no) AND l.line NOT IN (SELECT line FROM beaten))) AS stays
  FROM l LEFT JOIN v ON l.line = v.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (stays), '') AS text
FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END, 0, text FROM documents WHERE text IS NULL OR doc_id IS NULL
"""

_T = "('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10))"


def _mask(x: str) -> str:
    size = "length(t.role) + length(t.text) + 24"
    return f"""coalesce((SELECT string_agg(CASE WHEN role = 'assistant' THEN (pos + 13 + length(role))::VARCHAR || ':' || (pos + size)::VARCHAR END, ',' ORDER BY i) FROM (
      SELECT i, t.role AS role, {size} AS size, coalesce(sum({size}) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM (SELECT unnest({x}) AS t, generate_subscripts({x}, 1) AS i))), '')"""


PREFERENCES = f"""
WITH c AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
a AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY turns[1], conv_id % {PARTS}) AS n, lag(conv_id) OVER w AS before
  FROM c WINDOW w AS (PARTITION BY turns[1], conv_id % {PARTS} ORDER BY conv_id)),
p AS (SELECT before AS chosen_id, conv_id AS rejected_id FROM a WHERE r % 2 = 0),
o AS (SELECT *, row_number() OVER w AS s, lag(conv_id) OVER w AS prior FROM a WHERE r = n AND n % 2 = 1 WINDOW w AS (PARTITION BY turns[1] ORDER BY conv_id)),
q AS (SELECT prior AS chosen_id, conv_id AS rejected_id FROM o WHERE s % 2 = 0),
b AS (SELECT * FROM p UNION ALL SELECT * FROM q),
e AS (SELECT * FROM b UNION ALL SELECT conv_id, NULL FROM c WHERE conv_id NOT IN (SELECT chosen_id FROM b) AND conv_id NOT IN (SELECT rejected_id FROM b)),
f AS (SELECT chosen_id, rejected_id, x.turns AS a, y.turns AS b FROM e JOIN c x ON x.conv_id = chosen_id LEFT JOIN c y ON y.conv_id = rejected_id),
g AS (SELECT *, CASE WHEN b IS NULL THEN coalesce(list_max(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant')) - 1, len(a))
  ELSE coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) END AS n FROM f),
h AS (SELECT *, a[n + 1:] AS x, b[n + 1:] AS y FROM g)
SELECT chosen_id, rejected_id, n::BIGINT AS n_common,
  coalesce(array_to_string(list_transform(a[:n], lambda t: {_T}), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(x, lambda t: {_T}), ''), '') AS chosen,
  CASE WHEN b IS NOT NULL THEN coalesce(array_to_string(list_transform(y, lambda t: {_T}), ''), '') END AS rejected,
  {_mask("x")} AS chosen_mask, CASE WHEN b IS NOT NULL THEN {_mask("y")} END AS rejected_mask
FROM h
"""


def _spans(kind: str, regex: str, group: int, least: int, rank: int) -> str:
    r = regex.replace("'", "''")
    pieces = f"string_split_regex(text, '{r}')"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, pos AS a, pos + size AS z FROM (
  SELECT doc_id, i, g, length(m) AS size, (sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS pos FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '{r}', 0)) AS m, unnest(regexp_extract_all(text, '{r}', {group})) AS g,
      unnest({pieces}[:-2]) AS p, generate_subscripts(regexp_extract_all(text, '{r}', 0), 1) AS i FROM documents WHERE regexp_matches(text, '{r}')))
  WHERE length(g) >= {least}"""


#: The patterns as they are asked for, not the operator's own: kind, pattern, the group whose length counts, its least length.
_BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)
_MORE = (
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0, 0),
)
_ALL = "\nUNION ALL ".join(_spans(*r, k) for k, r in enumerate(_BASE + _MORE))
_COUNTS = ", ".join(f"count(*) FILTER (rank = {k})::BIGINT AS n_{r[0]}" for k, r in enumerate(_BASE))
SECRETS = f"""
WITH s AS ({_ALL})
SELECT doc_id, {_COUNTS},
  sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (rank < {len(_BASE)}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (rank IS NOT NULL), '') AS spans
FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
m AS (SELECT doc_id, i, n, item FROM (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)) JOIN q USING (n, key)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id),
r AS (SELECT doc_id, item, i - row_number() OVER (PARTITION BY doc_id, item, n ORDER BY i) AS run, i, n FROM (SELECT DISTINCT doc_id, item, i, n FROM m))
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""

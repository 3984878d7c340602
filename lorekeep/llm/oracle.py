"""DuckDB SQL for queries that SQL can express, by plain definitions over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: op3: all windows, the first of each kind, and the words that others cover.
SUBSTRING_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w)),
f AS (SELECT k, min({{'d': doc_id, 'p': p}}) AS f FROM win GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM win JOIN f USING (k) WHERE NOT (doc_id = f.d AND p = f.p)),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, ws, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(ws) AS n_words, len(ws) - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

#: op5: every pair that shares a shingle, by numbered occurrences, and the closure of its links.
NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
t AS (SELECT doc_id, ws, min(doc_id) OVER (PARTITION BY array_to_string(ws, ' ')) AS rep FROM w),
r AS (SELECT rep, ws FROM t WHERE doc_id = rep AND len(ws) > 0),
s AS (SELECT rep, array_to_string(ws[p:p + 4], ' ') AS s FROM (SELECT rep, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM r)),
nb AS (SELECT rep, s, row_number() OVER (PARTITION BY rep, s) AS o FROM s),
n AS (SELECT rep, count(*) AS n FROM nb GROUP BY rep),
ov AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i FROM nb a JOIN nb b ON a.s = b.s AND a.o = b.o AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM ov JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE i >= 0.8::DOUBLE * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(node, label) AS (SELECT DISTINCT rep, rep FROM t UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.node),
m AS (SELECT node, min(label) AS class_id FROM c GROUP BY node)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM t JOIN m ON node = rep
"""

_LETTERS = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_KEYS = "|".join([*map(_LETTERS, ("password", "passwd", "secret", "token")), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
ASSIGN = rf"""(?:{_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: op9: spans of each kind from the lengths of matches and of the text between, candidates and their owners.
SECRETS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(2)) AS owner, coalesce(source, chr(2)) || chr(1) || coalesce(lang, chr(2)) AS repo FROM documents),
x AS (SELECT doc_id, owner, repo, 'assign' AS kind, 0 AS rank, 8 AS least, regexp_extract_all(t, '{ASSIGN}', 0) AS m, regexp_extract_all(t, '{ASSIGN}', 1) AS g, string_split_regex(t, '{ASSIGN}') AS gap FROM d
  UNION ALL SELECT doc_id, owner, repo, 'access', 1, 16, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d WHERE contains(t, 'AKIA')
  UNION ALL SELECT doc_id, owner, repo, 'hex', 2, 32, regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0), string_split_regex(t, '[0-9a-f]+') FROM d WHERE regexp_matches(t, '[0-9a-f]{{32}}')
  UNION ALL SELECT doc_id, owner, repo, 'wide', 4, 20, regexp_extract_all(t, '[A-Za-z0-9_-]+', 0), regexp_extract_all(t, '[A-Za-z0-9_-]+', 0), string_split_regex(t, '[A-Za-z0-9_-]+') FROM d WHERE regexp_matches(t, '[A-Za-z0-9_-]{{20}}')),
u AS (SELECT doc_id, owner, repo, kind, rank, least, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(g) AS g, unnest(gap[1:len(m)]) AS gap FROM x WHERE len(m) > 0),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
q AS (SELECT doc_id, owner, repo, kind, rank, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(stop - length(g) AS BIGINT) AS vstart, g FROM p WHERE length(g) >= least AND (kind <> 'wide' OR (regexp_matches(g, '[0-9]') AND regexp_matches(g, '[A-Za-z]')))),
c AS (SELECT DISTINCT doc_id, owner, repo, vstart, stop, g FROM q),
o AS (SELECT g, count(DISTINCT owner) <= 1 AND count(DISTINCT owner || chr(3) || repo) <= 2 AS live FROM c GROUP BY g),
sp AS (SELECT doc_id, kind, rank, start, stop FROM q WHERE kind <> 'wide' UNION ALL SELECT doc_id, 'live', 3, vstart, stop FROM c JOIN o USING (g) WHERE live),
b AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans,
  count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'live') AS n_live FROM sp GROUP BY doc_id),
cp AS (SELECT doc_id, count(*) FILTER (WHERE NOT live) AS n_copied FROM c JOIN o USING (g) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN cp USING (doc_id)
"""

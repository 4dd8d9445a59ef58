"""SQL of the longer queries, for small tables."""

WORDS = r"list_filter(string_split_regex(%s, '[ \t-\r]+'), lambda w: w <> '')"

NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS % "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, CAST(greatest(len(w) - 4, 1) AS BIGINT))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

SUBSTRING_SQL = rf"""
WITH w AS (SELECT doc_id, {WORDS % "coalesce(text, '')"} AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, CAST(len(w) - 12 AS BIGINT))) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT g.doc_id, unnest(generate_series(g.i, g.i + 12)) AS p FROM g JOIN f ON g.g = f.g WHERE f.first_id < g.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, CAST(len(w) AS BIGINT))) AS p FROM w WHERE len(w) > 0),
kept AS (
  SELECT words.doc_id, count(gone.p) AS n_removed,
         string_agg(CASE WHEN gone.p IS NULL THEN words.word END, ' ' ORDER BY words.p) AS kept
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(kept.n_removed, 0) AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

# fixed values: the base patterns as stated; quotes are doubled for SQL
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RUNS = {"assign": (_ASSIGN, 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24), "owned": ("[A-Za-z0-9+/_=-]{20,}", 0, 20)}
_FOUND = " UNION ALL ".join(
    f"SELECT r, source, {k} AS k, '{name}' AS kind, {least} AS least, regexp_extract_all(x, '{p}') AS w, regexp_extract_all(x, '{p}', {g}) AS v, string_split_regex(x, '{p}') AS g FROM d WHERE regexp_matches(x, '{p}')"
    for k, (name, (p, g, least)) in enumerate(_RUNS.items())
)

SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS x FROM documents),
found AS ({_FOUND}),
each AS (SELECT r, source, k, kind, least, unnest(w) AS w, unnest(v) AS v, unnest(g[1 : len(w)]) AS gap, unnest(generate_series(1, len(w))) AS i FROM found),
placed AS (SELECT *, CAST(sum(length(gap) + length(w)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS b FROM each),
valid AS (SELECT r, source, k, kind, v, b - length(w) AS a, b FROM placed WHERE length(v) >= least AND (k < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))),
owned AS (SELECT v, count(DISTINCT coalesce(CAST(source AS VARCHAR), chr(1))) >= 3 AS copied FROM valid GROUP BY 1),
known AS (SELECT valid.*, copied FROM valid JOIN owned ON owned.v = valid.v),
kept AS (SELECT * FROM known s WHERE k < 3 OR (NOT copied AND NOT EXISTS (SELECT 1 FROM known t WHERE t.r = s.r AND t.k < 3 AND t.a < s.b AND s.a < t.b))),
told AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans,
    count(*) FILTER (WHERE copied) AS n_widely_copied, count(*) FILTER (WHERE NOT copied) AS n_owner_specific
  FROM kept GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_widely_copied, 0) AS n_widely_copied, coalesce(n_owner_specific, 0) AS n_owner_specific
FROM d LEFT JOIN told ON told.r = d.r
"""

_SPLIT = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

#: Every alignment of every document with every item that has a word in common. A window of the most equal words starts
#: at an equal word or is the last one that both texts have.
LEAKS_SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, {_SPLIT} AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT DISTINCT item_id, {_SPLIT} AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, len(w) AS dn, unnest(generate_series(0, len(w) - 1)) AS i, unnest(w) AS word FROM docs WHERE len(w) >= 8),
t AS (SELECT item_id, len(w) AS n, least(len(w), 13) AS size, unnest(generate_series(0, len(w) - 1)) AS j, unnest(w) AS word FROM items WHERE len(w) >= 8),
e AS (SELECT doc_id, item_id, i - j AS shift, j, size, greatest(0, j - i) AS lo, least(n, dn - i + j) AS hi FROM d JOIN t ON d.word = t.word),
s AS (SELECT doc_id, item_id, shift FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 8),
c AS (SELECT e.*, count(*) OVER (PARTITION BY e.doc_id, e.item_id, e.shift ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k
  FROM e JOIN s ON s.doc_id = e.doc_id AND s.item_id = e.item_id AND s.shift = e.shift),
best AS (
  SELECT doc_id, item_id, shift, size, greatest(coalesce(max(CASE WHEN j <= hi - size THEN k END), 0), count(*) FILTER (WHERE j >= hi - size)) AS matched
  FROM c WHERE hi - size >= lo GROUP BY 1, 2, 3, 4)
SELECT doc_id, item_id, count(*) AS n_places, CAST(max(matched) AS BIGINT) AS matched FROM best WHERE matched >= CASE WHEN size = 13 THEN 11 ELSE size END GROUP BY 1, 2
UNION ALL SELECT docs.doc_id, items.item_id, 1, CAST(len(items.w) AS BIGINT) FROM docs JOIN items ON docs.w = items.w WHERE len(items.w) BETWEEN 1 AND 7
"""

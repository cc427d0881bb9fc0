"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

_SPACES = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_SPACES}'), []) AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, p, array_to_string(w[p:p+12], ' ') AS s FROM g),
f AS (SELECT s, min(doc_id) AS least FROM k GROUP BY s),
r AS (SELECT DISTINCT k.doc_id, k.p + unnest(range(0, 13)) AS q FROM k JOIN f USING (s) WHERE k.doc_id > f.least),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
a AS (
  SELECT u.doc_id, count(*) FILTER (r.q IS NOT NULL) AS gone, coalesce(string_agg(u.word, ' ' ORDER BY u.q) FILTER (r.q IS NULL), '') AS kept
  FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND u.q = r.q GROUP BY u.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(a.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_low('text')}, '{_SPACES}'), []) AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p+3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT s.b, c.r FROM c JOIN s ON s.a = c.doc_id WHERE c.r < s.b),
m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, m.doc_id = component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_low('text')}, '{_LETTERS}'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_low('text')}, '{_LETTERS}'), []) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p+k-1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, p, array_to_string(w[p:p+k-1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)
),
h AS (SELECT doc_id, item_id, k, p FROM dw JOIN bw USING (k, s)),
x AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, p + unnest(range(0, k)) AS q FROM h) GROUP BY doc_id),
y AS (
  SELECT doc_id, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""

PREFERENCES = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
),
l AS (SELECT conv_id, arg_max(text, i) AS text FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (
  SELECT conv_id, i, role, text FROM t WHERE NOT (i = n AND role = 'assistant')
  UNION ALL
  SELECT t.conv_id, t.i, 'assistant', l.text FROM t JOIN l ON l.conv_id = xor(t.conv_id, 1) WHERE t.i = t.n AND t.role = 'assistant'
),
k AS (
  SELECT t.conv_id, coalesce(min(t.i) FILTER (r.i IS NULL OR r.role <> t.role OR r.text <> t.text) - 1, max(t.n)) AS n_common
  FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.i = t.i GROUP BY t.conv_id
),
s AS (SELECT 'c' AS side, conv_id, i, role, text FROM t UNION ALL SELECT 'r', conv_id, i, role, text FROM r),
m AS (
  SELECT s.side, s.conv_id, s.i, s.role, i <= n_common AS common, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head,
    '<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM s JOIN k USING (conv_id)
),
p AS (
  SELECT *, sum(length(body)) OVER (PARTITION BY side, conv_id ORDER BY i) AS till FROM m
)
SELECT k.conv_id, CAST(k.n_common AS BIGINT) AS n_common,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND common), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'c' AND NOT common), '') AS chosen,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (side = 'r' AND NOT common), '') AS rejected,
  coalesce(string_agg((till - length(body) + length(head)) || '-' || till, ',' ORDER BY i) FILTER (side = 'c' AND NOT common AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((till - length(body) + length(head)) || '-' || till, ',' ORDER BY i) FILTER (side = 'r' AND NOT common AND role = 'assistant'), '') AS rejected_spans,
  count(*) FILTER (NOT common) = 0 AS identical
FROM k JOIN p USING (conv_id) GROUP BY k.conv_id, k.n_common
"""

_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

DIVERGENCE = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
    regexp_extract_all({_low("coalesce(text, '')")}, '{_TERMS}') AS w
  FROM documents
),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
),
l AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term
),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""

_RUNS = r"[A-Za-z\x{00C0}-\x{00FF}]+"

VARIANTS = f"""
WITH RECURSIVE z AS (
  SELECT list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
),
r AS (
  SELECT i, k, run, count(*) AS n
  FROM (SELECT row_number() OVER () AS i, coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all({_low('text')}, '{_RUNS}')) AS run FROM documents)
  GROUP BY i, k, run
),
b AS (SELECT k, run, hex(encode(k || ':' || run)) AS x FROM (SELECT DISTINCT k, run FROM r)),
h AS (
  SELECT k, run, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda p: CAST('0x' || x[p:p+1] AS BIGINT))),
    lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) AS h
  FROM b, z
),
w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM r JOIN h USING (k, run))
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
p AS (SELECT word, left(word, i) || '*' || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
e AS (
  SELECT a.word AS a, b.word AS b FROM p a JOIN p b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT p.word, w.word FROM p JOIN w ON w.word = p.less
  UNION SELECT w.word, p.word FROM p JOIN w ON w.word = p.less
),
m AS (
  SELECT e.a AS word, count(*) AS n_near, max(y.n) AS most FROM e JOIN w y ON y.word = e.b GROUP BY e.a
),
f AS (
  SELECT m.word, min(e.b) AS form, any_value(m.most) AS form_n
  FROM m JOIN w x ON x.word = m.word JOIN e ON e.a = m.word JOIN w y ON y.word = e.b AND y.n = m.most
  WHERE m.most >= 2 * x.n GROUP BY m.word
),
c AS (SELECT word, form AS root, 1 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.root),
g AS (SELECT word, max_by(root, depth) AS root FROM c GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n
FROM w LEFT JOIN m USING (word) LEFT JOIN f USING (word) LEFT JOIN g USING (word)
"""

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

ORACLES = {
    "op2_substring_dedup": SUBSTRINGS,
    "op5_minhash_near_dedup": NEAR_DUPLICATES,
    "op6_decontamination": DECONTAMINATION,
    "op9_chat_formatting": PREFERENCES,
    "op11_source_divergence": DIVERGENCE,
    "op12_spelling_variants": VARIANTS,
    "op13_exact_dedup": EXACT,
}

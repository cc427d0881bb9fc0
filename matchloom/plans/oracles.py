"""DuckDB SQL for the registered queries: the same results by brute force over the same tables."""

from __future__ import annotations

# The white space stripped from texts, as a regular-expression class.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

GAPPY = """gappy AS (SELECT p_partkey,
  CASE p_size % 5 WHEN 0 THEN 'nan' WHEN 1 THEN '---' WHEN 2 THEN '- -' ELSE p_name END AS name,
  CASE WHEN p_size % 7 <> 0 THEN p_size END AS size,
  CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS price,
  CASE WHEN p_size % 5 > 2 THEN concat(' ', chr(9), p_brand, ',Inc. ', chr(10)) END AS brand FROM part)"""
MASTER = """master AS (SELECT p_partkey AS m_id,
  concat(split_part(p_name, ' ', 2), ', ', upper(split_part(p_name, ' ', 1))) AS m_name,
  p_type AS m_type, p_brand AS m_brand FROM part)"""


def cell(c: str) -> str:
    return f"CASE WHEN CAST({c} AS VARCHAR) <> 'nan' THEN CAST({c} AS VARCHAR) ELSE '' END"


def combined(*cols: str) -> str:
    return "concat(" + ", ".join(f"{cell(c)}, ' '" for c in cols) + ")"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


def clean(*cols: str) -> str:
    return f"regexp_replace(lower({strip(combined(*cols))}), '[.,-]', '', 'g')"


def shown(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'nan')"


def round1(x: str) -> str:
    """One decimal on the exact binary value, ties to even."""
    t = f"(CAST(({x}) * 4503599627370496.0::DOUBLE AS BIGINT) * 10)"
    half, mask = 1 << 51, (1 << 52) - 1
    return (
        f"((({t} >> 52) + CASE WHEN ({t} & {mask}) > {half} THEN 1 "
        f"WHEN ({t} & {mask}) = {half} AND (({t} >> 52) & 1) = 1 THEN 1 ELSE 0 END)::DOUBLE / 10.0::DOUBLE)"
    )


def key_rows(name: str, source: str, rid: str, *cols: str) -> str:
    return f"{name}_rows AS (SELECT *, {rid} AS rid, {clean(*cols)} AS key FROM {source})"


def key_list(name: str) -> str:
    return (
        f"{name} AS (SELECT key, min(rid) AS pos, max(rid) AS last_rid FROM {name}_rows "
        "WHERE key <> '' GROUP BY key)"
    )


def forms(name: str) -> str:
    """Sorted words, length, characters, and the bit mask of each character."""
    sorted_words = f"array_to_string(list_sort(list_filter(regexp_split_to_array(key, '{_WS}+'), lambda w: w <> '')), ' ')"
    bits = "list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN ch[i] = c THEN (1::HUGEINT << (i - 1)::HUGEINT) ELSE 0::HUGEINT END))::HUGEINT"
    return (
        f"{name}_form AS (SELECT pos, {sorted_words} AS form FROM {name}), "
        f"{name}_bits AS (SELECT pos, form, n, ch, map_from_entries(list_transform(list_distinct(ch), "
        f"lambda c: struct_pack(k := c, v := {bits}))) AS mask "
        f"FROM (SELECT pos, form, length(form) AS n, string_split(form, '') AS ch FROM {name}_form))"
    )


LCS = (
    "a.n - bit_count(list_reduce(list_transform(b.ch, lambda c: coalesce(a.mask[c], 0::HUGEINT)), "
    "lambda v, x: ((v + (v & x)) | (v - (v & x))) & ((1::HUGEINT << a.n::HUGEINT) - 1), "
    "(1::HUGEINT << a.n::HUGEINT) - 1))"
)


def fuzzy(a: str, b: str | None, cutoff: int, k: int) -> str:
    """CTE ``pairs``: pos_a, pos_b, raw, rank over all pairs."""
    on = "a.pos < b.pos" if b is None else "true"
    with_b = "" if b is None else f", {forms(b)}"
    return f"""{forms(a)}{with_b},
all_pairs AS (SELECT a.pos AS pos_a, b.pos AS pos_b, a.n + b.n AS total, {LCS} AS lcs
  FROM {a}_bits a JOIN {b or a}_bits b ON {on}),
near AS (SELECT pos_a, pos_b, (1.0::DOUBLE - (total - 2 * lcs)::DOUBLE / total::DOUBLE) * 100.0::DOUBLE AS raw
  FROM all_pairs WHERE 200 * lcs >= {cutoff} * total),
pairs AS (SELECT pos_a, pos_b, raw, CAST(row_number() OVER (PARTITION BY pos_a ORDER BY raw DESC, pos_b) AS INTEGER) AS rank
  FROM near QUALIFY rank <= {k})"""


def grams(corpus: str) -> str:
    return f"""words AS (SELECT side, pos, concat(' ', unnest(list_filter(regexp_split_to_array(key, '{_WS}+'), lambda w: w <> '')), ' ') AS w FROM {corpus}),
grams AS (SELECT side, pos, substr(w, i, n) AS gram FROM (
  SELECT side, pos, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM words, (VALUES (2), (3), (4)) s(n) WHERE n <= length(w))),
tf AS (SELECT side, pos, gram, count(*) AS tf FROM grams GROUP BY ALL),
dfs AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram)"""


def weights(corpus: str) -> str:
    return f"""{grams(corpus)},
raw AS (SELECT side, pos, gram, tf, df, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM {corpus})) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE) AS r
  FROM tf JOIN dfs USING (gram)),
weights AS (SELECT side, pos, gram, tf, df, r / sqrt(sum(r * r) OVER (PARTITION BY side, pos)) AS weight FROM raw)"""


def tfidf(a: str, b: str | None, cutoff: int, k: int) -> str:
    """CTE ``pairs`` over the cosines of all pairs that share a gram."""
    union = "" if b is None else f" UNION ALL SELECT 'b', pos, key FROM {b}"
    on = "x.side = 'a' AND y.side = 'b'" if b is not None else "x.pos < y.pos"
    return f"""corpus AS (SELECT 'a' AS side, pos, key FROM {a}{union}), {weights("corpus")},
near AS (SELECT x.pos AS pos_a, y.pos AS pos_b, round(sum(x.weight * y.weight), 9) * 100.0::DOUBLE AS raw
  FROM weights x JOIN weights y ON x.gram = y.gram AND {on} GROUP BY ALL
  HAVING round(sum(x.weight * y.weight), 9) >= ({cutoff}::DOUBLE / 100.0::DOUBLE)),
pairs AS (SELECT pos_a, pos_b, raw, CAST(row_number() OVER (PARTITION BY pos_a ORDER BY raw DESC, pos_b DESC) AS INTEGER) AS rank
  FROM near QUALIFY rank <= {k})"""


SCORED = f"SELECT pos_a, pos_b, {round1('raw')} AS score, rank FROM pairs"
PART = f"{key_rows('p', 'part', 'p_partkey', 'p_name', 'p_brand')}, {key_list('p')}"
PART3 = f"{key_rows('p', 'part', 'p_partkey', 'p_name', 'p_brand', 'p_type')}, {key_list('p')}"
PART_TYPE = f"{key_rows('p', 'part', 'p_partkey', 'p_name', 'p_type')}, {key_list('p')}"
MASTER_KEYS = f"{MASTER}, {key_rows('m', 'master', 'm_id', 'm_name', 'm_type')}, {key_list('m')}"
CUSTOMER = f"{key_rows('c', 'customer', 'c_custkey', 'c_name')}, {key_list('c')}"
SUPPLIER = f"{key_rows('s', 'supplier', 's_suppkey', 's_name')}, {key_list('s')}"


def text_of(alias: str, *cols: str) -> str:
    return "concat_ws(' | ', " + ", ".join(shown(f"{alias}.{c}") for c in cols) + ")"


def numbered(name_b: str, rows_b: str, cols_a: tuple[str, ...], cols_b: tuple[str, ...]) -> str:
    """CTE ``found``: the match table; ra and rb are the shown rows."""
    return f"""found AS (SELECT row_number() OVER (ORDER BY score DESC, pos_a, rank) AS match_id, * FROM (
  SELECT {round1('raw')} AS score, {text_of('ra', *cols_a)} AS match_a, {text_of('rb', *cols_b)} AS match_b,
    ra, rb, pos_a, pos_b, rank
  FROM pairs JOIN p ON p.pos = pos_a JOIN {name_b} b ON b.pos = pos_b
  JOIN p_rows ra ON ra.rid = p.last_rid JOIN {rows_b} rb ON rb.rid = b.last_rid))"""




def found(k: int) -> str:
    return f"{PART}, {fuzzy('p', None, 85, k)}, {numbered('p', 'p_rows', PART_COLS, PART_COLS)}"


PART_COLS = ("p_name", "p_brand")
FOUND = found(5)
PART_FIELDS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
PREFIXED = ", ".join([f"ra.{c} AS A_{c}" for c in PART_FIELDS] + [f"rb.{c} AS B_{c}" for c in PART_FIELDS])
BUCKET = (
    "CASE WHEN score >= 100 THEN '100' WHEN score >= 90 THEN '90–100' WHEN score >= 80 THEN '80–90' "
    "WHEN score >= 70 THEN '70–80' WHEN score >= 60 THEN '60–70' ELSE '50–60' END"
)
HISTOGRAM = f"""hist AS (SELECT bucket, count(score) AS n FROM
  (VALUES ('50–60'), ('60–70'), ('70–80'), ('80–90'), ('90–100'), ('100')) v(bucket)
  LEFT JOIN (SELECT score, {BUCKET} AS bucket FROM found) USING (bucket) GROUP BY bucket)"""


def log(by_type: bool) -> str:
    session = "event_type" if by_type else "'all'"
    return f"""events_log AS (SELECT {session} AS session, event_id * 20 AS seq, ts,
  ['A', 'B', 'F', 'S', 'U'][user_id % 5 + 1] AS choice, props AS note FROM events),
sums AS (SELECT *, sum(CASE choice WHEN 'U' THEN -1 ELSE 1 END) OVER (PARTITION BY session ORDER BY seq) AS s FROM events_log),
lows AS (SELECT *, least(0, min(s) OVER (PARTITION BY session ORDER BY seq)) AS low FROM sums),
replay AS (SELECT *, CAST(s - low AS BIGINT) AS idx,
  CAST(CASE choice WHEN 'U' THEN s - low ELSE s - low - 1 END AS BIGINT) AS touched,
  choice = 'U' AND low < coalesce(lag(low) OVER (PARTITION BY session ORDER BY seq), 0) AS noop FROM lows)"""


def cut(n: str) -> str:
    return f"""cut AS (SELECT r.* FROM replay r LEFT JOIN
  (SELECT session, min(seq) AS last_seq FROM replay WHERE idx = {n} GROUP BY session) e USING (session)
  WHERE (last_seq IS NULL OR seq <= last_seq) AND touched < {n})"""


def decided(source: str) -> str:
    return f"""decided AS (SELECT session, touched + 1 AS match_id, arg_max(choice, seq) AS choice,
  arg_max(note, seq) AS note, max(seq) AS seq FROM {source} WHERE NOT noop GROUP BY ALL HAVING arg_max(choice, seq) <> 'U')"""


REVIEW = f"{log(False)}, {cut('(SELECT count(*) FROM found)')}, {decided('cut')}"
REVIEWED = f"{FOUND}, {REVIEW}"
ACTION = "CASE choice WHEN 'A' THEN 'Kept Original' WHEN 'B' THEN '{}' ELSE 'Flagged for Review' END"
SELECTION = "CASE choice WHEN 'A' THEN match_a WHEN 'B' THEN match_b ELSE '' END"


def records(id_b: str, label: str, override: str) -> str:
    return f"""records AS (SELECT CAST(ra.p_partkey AS VARCHAR) AS "Primary_ID", CAST(rb.{id_b} AS VARCHAR) AS "{label}",
  match_a AS "Primary Item", match_b AS "Matched Item", score AS "Score", note AS "Note",
  {SELECTION} AS "Final Selection", {ACTION.format(override)} AS "Action"
  FROM found JOIN decided USING (match_id) WHERE choice <> 'S')"""


RECORDS = f"{REVIEWED}, {records('p_partkey', 'Duplicate_ID', 'Merged Duplicate')}"
MASTER_COLS = (("p_name", "p_type"), ("m_name", "m_type"))


def master_found(pairs: str) -> str:
    return f"{PART_TYPE}, {MASTER_KEYS}, {pairs}, {numbered('m', 'm_rows', *MASTER_COLS)}"


DOCS = f"{key_rows('d', 'documents', 'doc_id', 'text')}, {key_list('d')}"


def bit_ratio(a: str, b: str) -> str:
    """Token-sort score of two texts of one row of ``t``, as a CTE chain ending in ``scored``."""
    return f"""left_keys AS (SELECT id AS pos, {a} AS key FROM t), right_keys AS (SELECT id AS pos, {b} AS key FROM t),
{forms('left_keys')}, {forms('right_keys')},
scored AS (SELECT a.pos AS id, CASE WHEN a.n + b.n = 0 THEN 100.0 ELSE
  (1.0::DOUBLE - (a.n + b.n - 2 * ({LCS}))::DOUBLE / (a.n + b.n)::DOUBLE) * 100.0::DOUBLE END AS ratio
  FROM left_keys_bits a JOIN right_keys_bits b USING (pos))"""


FIELD_PAIRS = (("p_name", "p_name"), ("p_type", "p_brand"), ("p_retailprice", "p_size"), ("p_name", None))
FIELD_ROWS = " UNION ALL ".join(
    f"SELECT match_id, {n} AS field, '{p}' AS p_col, '{m or 'p_unknown'}' AS m_col, {shown(f'ra.{p}')} AS val_a, "
    f"{shown(f'rb.{m}') if m else chr(39) + '—' + chr(39)} AS val_b FROM found"
    for n, (p, m) in enumerate(FIELD_PAIRS, 1)
)
CONTEXT = {
    side: "concat_ws('  |  ', " + ", ".join(f"concat('{c}: ', {shown(f'{side}.{c}')})" for c in PART_FIELDS) + ")"
    for side in ("ra", "rb")
}
AUDIT = """CASE choice
  WHEN 'U' THEN concat('UNDO: reverted decision [', reverted, '] at index ', touched)
  WHEN 'S' THEN concat('DECISION [Skip] #', match_id, ' | A=''', match_a, ''' | B=''', match_b, '''')
  ELSE concat('DECISION [', CASE choice WHEN 'A' THEN 'Keep A' WHEN 'B' THEN 'Override B' ELSE 'Flag' END, '] #', match_id,
    ' | Score=', CAST(score AS VARCHAR), ' | A=''', match_a, ''' | B=''', match_b, ''' | Note=''', note, '''') END"""
ETA = """CASE WHEN reviewed = 0 THEN '–'
  WHEN sec < 60 THEN concat(CAST(floor(sec) AS BIGINT), 's')
  ELSE concat(CAST(floor(sec / 60) AS BIGINT), 'm ', CAST(floor(sec) AS BIGINT) - 60 * CAST(floor(sec / 60) AS BIGINT), 's') END"""

ORACLES: dict[str, str] = {
    "read_table": f"WITH {GAPPY} SELECT p_partkey, nullif(name, 'nan') AS name, CAST(coalesce(size, -1) AS BIGINT) AS size, coalesce(price, -1) AS price FROM gappy",
    "normalise_missing": "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'click', 'view') THEN event_type END AS kind FROM events",
    "read_columns": f"SELECT {', '.join(f'count({c}) AS {c}' for c in PART_FIELDS)} FROM part",
    "with_row_order": "SELECT c_name, c_custkey AS rid FROM customer",
    "head_sample": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100",
    "export_matches": f'WITH {FOUND} SELECT score AS "Score (%)", match_a AS "Primary Item", match_b AS "Matched Item", {PREFIXED} FROM found',
    "export_decisions": f"""WITH {RECORDS} SELECT *, CASE "Action" WHEN 'Flagged for Review' THEN "Action" ELSE 'Decisions' END AS sheet FROM records""",
    "save_and_load_session": f"WITH {FOUND}, {log(False)} SELECT 'match' AS kind, match_id AS n, match_a AS text FROM found UNION ALL SELECT 'event', seq, choice FROM events_log",
    "scan_settings": "SELECT 'part.parquet' AS file, 'fuzzy' AS engine, 85 AS cutoff, 5 AS max_limit, 'dedupe' AS mode, false AS test_mode, 'p_name,p_brand' AS primary_cols, count(*) AS n_rows FROM part",
    "audit_trail": f"""WITH {FOUND}, {log(True)}, {cut('(SELECT count(*) FROM found)')},
real AS (SELECT *, lag(choice) OVER (PARTITION BY session, touched ORDER BY seq) AS reverted FROM cut WHERE NOT noop)
SELECT session, seq, {AUDIT} AS line FROM real JOIN found ON match_id = touched + 1""",
    "blank_missing_cells": f"WITH {GAPPY} SELECT p_partkey, {cell('name')} AS name, {cell('size')} AS size, {cell('price')} AS price FROM gappy",
    "combine_cols": f"WITH {GAPPY} SELECT p_partkey, {combined('name', 'size', 'price')} AS combined FROM gappy",
    "clean_keys": f"WITH {GAPPY} SELECT p_partkey, {clean('brand', 'name', 'price')} AS key FROM gappy",
    "clean_documents": f"SELECT doc_id, CAST(length(key) AS INTEGER) AS n, md5(key) AS digest FROM (SELECT doc_id, {clean('text', 'lang')} AS key FROM documents)",
    "drop_empty": f"WITH {GAPPY} SELECT * FROM (SELECT p_partkey, {clean('name')} AS key FROM gappy) WHERE key <> ''",
    "display_values": f"WITH {GAPPY} SELECT p_partkey, {text_of('gappy', 'name', 'price', 'size')} AS shown FROM gappy",
    "row_contexts": "WITH " + GAPPY + " SELECT p_partkey, concat_ws('  |  ', " + ", ".join(f"concat('{c}: ', {shown(c)})" for c in ("p_partkey", "name", "size", "price")) + ") AS context FROM gappy",
    "apply_column_mappings": f"WITH {PART_TYPE}, {MASTER_KEYS} SELECT 'primary' AS side, rid, key FROM p_rows UNION ALL SELECT 'master', rid, key FROM m_rows",
    "round_scores": f"SELECT l_orderkey, l_linenumber, {round1('raw')} AS score FROM (SELECT *, (l_partkey % 1001)::DOUBLE / 10.0::DOUBLE * 0.5::DOUBLE + 25.25::DOUBLE AS raw FROM lineitem)",
    "above_cutoff": f"WITH {PART_TYPE}, {MASTER_KEYS}, {fuzzy('p', 'm', 100, 1)} SELECT pos_a, pos_b, raw FROM pairs",
    "score_bands": f"WITH {FOUND} SELECT CASE WHEN score >= 95 THEN 'high' WHEN score >= 85 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM found GROUP BY ALL",
    "prefix_rows": f"WITH {FOUND} SELECT match_id, {PREFIXED} FROM found",
    "project_ids": f'WITH {FOUND} SELECT match_id, CAST(ra.p_partkey AS VARCHAR) AS "Primary_ID", CAST(rb.p_partkey AS VARCHAR) AS "Duplicate_ID" FROM found',
    "trim_notes": "SELECT event_id * 20 AS seq, props AS note FROM events",
    "mode_labels": f"WITH {FOUND} SELECT 'dedupe' AS mode, 'Dedupe_Scan' AS scan, 'Final_Internal_Dedupe' AS final, 'Duplicate_ID' AS other_id, 'Merged Duplicate' AS override, count(*) AS n FROM found",
    "match_context": f"WITH {FOUND} SELECT match_id, {CONTEXT['ra']} AS context_a, {CONTEXT['rb']} AS context_b FROM found",
    "token_sort_forms": f"WITH {PART}, {forms('p')} SELECT pos, form FROM p_form",
    "token_sort_ratio": f"""WITH t AS (SELECT a.p_partkey AS id, concat_ws(' ', a.p_name, a.p_brand, a.p_type) AS a, concat_ws(' ', b.p_name, b.p_brand, b.p_type) AS b
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), {bit_ratio('a', 'b')} SELECT id AS p_partkey, ratio FROM scored""",
    "char_ngrams": f"WITH {PART}, corpus AS (SELECT 'a' AS side, pos, key FROM p), {grams('corpus')} SELECT pos, gram, tf AS n FROM tf",
    "tfidf_weights": f"WITH {PART}, corpus AS (SELECT 'a' AS side, pos, key FROM p), {weights('corpus')} SELECT pos, gram, tf, df, round(weight, 9) AS weight FROM weights",
    "cosine": f"WITH {PART_TYPE}, {MASTER_KEYS}, {tfidf('p', 'm', 50, 1)} SELECT pos_a, pos_b, round(raw / 100, 8) AS cosine FROM pairs",
    "field_scores": f"""WITH {FOUND}, field_rows AS (SELECT row_number() OVER () AS id, * FROM ({FIELD_ROWS})),
t AS (SELECT min(id) AS id, val_a, val_b FROM field_rows GROUP BY val_a, val_b), {bit_ratio('val_a', 'val_b')}
SELECT match_id, field, p_col, m_col, val_a, val_b, round(ratio, 9) AS field_score
FROM field_rows JOIN t USING (val_a, val_b) JOIN scored ON scored.id = t.id""",
    "fuzzy_dedupe": f"WITH {PART}, {fuzzy('p', None, 85, 5)} {SCORED}",
    "fuzzy_dedupe_by_signatures": f"WITH {PART3}, {fuzzy('p', None, 90, 3)} {SCORED}",
    "fuzzy_dedupe_by_pivots": f"WITH {PART3}, {fuzzy('p', None, 85, 5)} {SCORED}",
    "fuzzy_master": f"WITH {PART_TYPE}, {MASTER_KEYS}, {fuzzy('p', 'm', 85, 5)} {SCORED}",
    "fuzzy_master_indexed": f"WITH {PART_TYPE}, {MASTER_KEYS}, {fuzzy('p', 'm', 85, 5)} {SCORED}",
    "fuzzy_master_by_pivots": f"WITH {PART_TYPE}, {MASTER_KEYS}, {fuzzy('p', 'm', 85, 5)} {SCORED}",
    "fuzzy_customers_to_suppliers": f"WITH {CUSTOMER}, {SUPPLIER}, {fuzzy('c', 's', 60, 10)} {SCORED}",
    "top_k_fuzzy": f"WITH {PART}, {fuzzy('p', None, 50, 1)} {SCORED}",
    "fuzzy_customers": f"WITH {CUSTOMER}, {fuzzy('c', None, 85, 20)} {SCORED}",
    "idf_corpus": f"WITH {PART_TYPE}, {MASTER_KEYS} SELECT key, count(*) AS n FROM (SELECT key FROM p UNION ALL SELECT key FROM m) GROUP BY key",
    "document_frequency": f"WITH {PART_TYPE}, {MASTER_KEYS}, corpus AS (SELECT 'a' AS side, pos, key FROM p UNION ALL SELECT 'b', pos, key FROM m), {grams('corpus')} SELECT gram, df FROM dfs",
    "tfidf_dedupe": f"WITH {PART3}, {tfidf('p', None, 85, 5)} {SCORED}",
    "tfidf_dedupe_by_pivots": f"WITH {PART3}, {tfidf('p', None, 85, 5)} {SCORED}",
    "tfidf_dedupe_by_signatures": f"WITH {PART3}, {tfidf('p', None, 70, 3)} {SCORED}",
    "tfidf_master": f"WITH {PART_TYPE}, {MASTER_KEYS}, {tfidf('p', 'm', 60, 5)} {SCORED}",
    "tfidf_master_by_pivots": f"WITH {PART_TYPE}, {MASTER_KEYS}, {tfidf('p', 'm', 60, 5)} {SCORED}",
    "top_k_tfidf": f"WITH {PART}, {tfidf('p', None, 50, 1)} {SCORED}",
    "near_duplicate_docs": f"WITH {DOCS}, {tfidf('d', None, 85, 5)} {SCORED}",
    "attach_rows": f"WITH {PART}, {fuzzy('p', None, 85, 3)}, {numbered('p', 'p_rows', ('p_name',), ('p_name',))} SELECT pos_a, pos_b, rank, {PREFIXED} FROM found",
    "join_back": f"""WITH {RECORDS} SELECT p_partkey, p_name, "Final Selection" AS selection, "Action" AS action, "Duplicate_ID" AS duplicate_id
FROM part LEFT JOIN records ON CAST(p_partkey AS VARCHAR) = "Primary_ID" """,
    "pending_matches": f"WITH {found(10)}, {REVIEW} SELECT match_id, score, match_a, match_b FROM found ANTI JOIN decided USING (match_id)",
    "attach_decisions": f"WITH {REVIEWED} SELECT match_id, score, match_a, match_b, choice, note FROM found JOIN decided USING (match_id)",
    "distinct_keys": f"WITH {PART} SELECT key, pos FROM p",
    "last_row_lookup": f"WITH {PART} SELECT p.key, {', '.join(f'r.{c}' for c in PART_FIELDS)} FROM p JOIN p_rows r ON r.rid = p.last_rid",
    "score_histogram": f"WITH {FOUND}, {HISTOGRAM} SELECT bucket, n FROM hist",
    "histogram_scale": f"WITH {FOUND}, {HISTOGRAM} SELECT bucket, n, n::DOUBLE / greatest(max(n) OVER (), 1)::DOUBLE AS share FROM hist",
    "rank_matches": f"WITH {FOUND} SELECT match_id, score, pos_a, pos_b, rank FROM found",
    "scan_metrics": f"WITH {PART_TYPE}, {MASTER_KEYS}, {fuzzy('p', 'm', 85, 5)} SELECT (SELECT count(*) FROM p) AS unique_primary, (SELECT count(*) FROM m) AS unique_master, (SELECT count(*) FROM pairs) AS n_matches",
    "scan_products": f"""WITH {PART_TYPE}, {MASTER_KEYS}, {fuzzy('p', 'm', 85, 5)}
SELECT (SELECT count(*) FROM p) AS unique_primary, (SELECT count(*) FROM m) AS unique_master, (SELECT count(*) FROM pairs) AS n_matches,
  (SELECT count(*) FROM pairs) AS n_exported, (SELECT count(*) FROM (SELECT score FROM ({SCORED}) WHERE score = 100)) AS n_equal,
  (SELECT count(*) FROM pairs) AS n_in_session, 'master' AS mode, 85 AS cutoff""",
    "review_summary": f"""WITH {REVIEWED} SELECT count(*) FILTER (choice IN ('A', 'B')) AS approved, count(*) FILTER (choice = 'F') AS flagged,
  count(*) FILTER (choice = 'S') AS skipped, (SELECT count(*) FROM found) - count(*) AS remaining FROM decided""",
    "review_eta": f"""WITH {FOUND}, {log(True)}, {cut('(SELECT count(*) FROM found)')},
e AS (SELECT session, arg_max(idx, seq) AS reviewed, (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / 1e6::DOUBLE AS elapsed FROM cut GROUP BY session),
f AS (SELECT session, reviewed, (SELECT count(*) FROM found) - reviewed AS remaining, elapsed / reviewed * ((SELECT count(*) FROM found) - reviewed) AS sec FROM e)
SELECT session, reviewed, remaining, {ETA} AS eta FROM f""",
    "replay_index": f"WITH {log(True)} SELECT session, seq, choice, idx FROM replay",
    "in_range": f"WITH {PART}, {log(False)}, {cut('(SELECT count(*) FROM p)')} SELECT seq, choice, idx FROM cut",
    "effective_decisions": f"WITH {log(True)}, {decided('replay')} SELECT * FROM decided",
    "decision_records": f"WITH {RECORDS} SELECT * FROM records",
    "all_decisions": f"""WITH {RECORDS} SELECT "Action", count(*) AS n, round(sum("Score"), 1) AS total FROM records GROUP BY ALL""",
    "flagged": f"""WITH {RECORDS} SELECT * FROM records WHERE "Action" = 'Flagged for Review'""",
    "dedupe": f"WITH {FOUND} SELECT match_id, score, match_a, match_b, ra.p_partkey AS p_partkey, rb.p_partkey AS other, rank FROM found",
    "dedupe_sampled": f"""WITH first_rows AS (SELECT * FROM part ORDER BY p_partkey LIMIT 100), {key_rows('p', 'first_rows', 'p_partkey', 'p_name')}, {key_list('p')},
{tfidf('p', None, 50, 3)}, {numbered('p', 'p_rows', ('p_name',), ('p_name',))} SELECT match_id, score, match_a, match_b, pos_a, pos_b FROM found""",
    "map_to_master": f"""WITH {master_found(tfidf('p', 'm', 60, 3))}
SELECT match_id, score, match_a, match_b, CAST(ra.p_partkey AS VARCHAR) AS "Primary_ID", CAST(rb.m_id AS VARCHAR) AS "Master_ID" FROM found""",
    "review_job": f"""WITH {master_found(fuzzy('p', 'm', 85, 10))}, {log(False)}, {cut('(SELECT count(*) FROM found)')}, {decided('cut')},
{records('m_id', 'Master_ID', 'Mapped to Master')} SELECT * FROM records""",
    "resume": f"WITH {found(10)}, {REVIEW} SELECT match_id, match_a, match_b FROM found ANTI JOIN decided USING (match_id)",
}

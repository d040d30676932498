"""DuckDB SQL with the same rows as the queries of this package, written from their definitions."""

from __future__ import annotations

from ..functions import fixed


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _squeeze(x: str) -> str:
    return _strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def _marker(x: str) -> str:
    out = rf"regexp_replace(coalesce({x}, ''), '^\s*(#{{1,9}}|\*\*\*|//)\s*', '')"
    out = rf"regexp_replace({out}, '\s*(#{{1,9}}|\*\*\*|\\)\s*$', '')"
    return _squeeze(rf"regexp_replace({out}, '\*{{2,}}', '', 'g')")


def _marker_or_null(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {_marker(x)} END"


def _clean(x: str) -> str:
    return _strip(rf"regexp_replace(translate(coalesce({x}, ''), chr(13) || chr(10) || chr(7), ''), '[\t ]+', ' ', 'g')")


def _normal(x: str) -> str:
    return f"lower({_squeeze(x)})"


def _point(x: str) -> str:
    tries = [r"^\s*\{([^}]*\d[^}]*)\}", r"^\s*(\d+(?:[\.\-]\d+)+)\s", r"^\s*(\d+(?:[\.\-]\d+)*)\."]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in tries) + ", '')"


_SKIP = r"(text = '' OR regexp_full_match(text, '[-–—]?\s*\d+\s*[-–—]?'))"
_LEVEL = r"""CASE WHEN outline BETWEEN 1 AND 9 THEN least(outline, 6)
  WHEN length(text) < 180 AND regexp_matches(text, '^[IVXLCDM]+\.\s+\S+') THEN 1
  WHEN length(text) BETWEEN 12 AND 180 AND upper(text) = text AND regexp_matches(text, '[A-Z]{4,}') AND NOT regexp_matches(text, '\d{4}|(^|[^\pL\pN_])N($|[^\pL\pN_])') THEN 2 END"""


def _paragraphs(raw: str) -> str:
    """CTEs from raw (doc_key, ord, raw, outline) to p (doc_key, ord, paragraph_index, text, level, point, char_start, char_end)."""
    return f"""raw AS ({raw}), cleaned AS (SELECT *, {_clean('raw')} AS text FROM raw),
placed AS (SELECT *, NOT {_SKIP} AS kept, coalesce(sum(CASE WHEN NOT {_SKIP} THEN length(text) + 1 ELSE length(raw) END) OVER w, 0)::BIGINT AS char_start, coalesce(sum((NOT {_SKIP})::INT) OVER w, 0)::BIGINT AS paragraph_index
  FROM cleaned WINDOW w AS (PARTITION BY doc_key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT doc_key, ord, paragraph_index, text, {_LEVEL} AS level, {_point('text')} AS point, char_start, char_start + length(text) AS char_end FROM placed WHERE kept)"""


_LINES = "SELECT doc_id AS doc_key, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, 10 AS outline FROM documents"
_TURNS = "SELECT conv_id AS doc_key, turn AS ord, text AS raw, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 10 END AS outline FROM conversations"
#: The headings that a turn stands under: the last of level 1, and the last of level 2 unless one of level 1 follows it.
_PATHS = f"""WITH {_paragraphs(_TURNS)},
h AS (SELECT *, max(CASE WHEN level = 1 THEN ord END) OVER w AS a, max(CASE WHEN level = 2 THEN ord END) OVER w AS b FROM p WINDOW w AS (PARTITION BY doc_key ORDER BY ord)),
paths AS (SELECT h.*, list_filter([{_marker_or_null('x.text')}, CASE WHEN h.b > coalesce(h.a, -1) THEN {_marker_or_null('y.text')} END], lambda s: s IS NOT NULL) AS path FROM h
  LEFT JOIN p x ON x.doc_key = h.doc_key AND x.ord = h.a LEFT JOIN p y ON y.doc_key = h.doc_key AND y.ord = h.b)"""


def _chunks(most: int = 1600, name: str = "") -> str:
    """CTEs that end in chunks{name}, one row a chunk with its payload."""
    n = name
    return rf"""d{n} AS (SELECT doc_id AS doc_key, source AS doc_name, {_marker('text')} AS t FROM documents),
f{n} AS (SELECT doc_key, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s, 1 AS i, []::VARCHAR[] AS parts, '' AS cur FROM d{n} WHERE length(t) > {most}
 UNION ALL SELECT doc_key, s, i + 1,
  CASE WHEN fits THEN parts ELSE list_concat(list_concat(parts, CASE WHEN cur <> '' THEN [cur] ELSE [] END), cuts[:len(cuts)-1]) END,
  CASE WHEN NOT fits THEN cuts[len(cuts)] WHEN cur = '' THEN x WHEN x = '' THEN cur ELSE cur || ' ' || x END
 FROM (SELECT *, s[i] AS x, length(cur) + length(s[i]) + 1 <= {most} AS fits, list_transform(range(0, greatest(ceil(length(s[i]) / {most})::BIGINT, 1)), lambda k: substr(s[i], k * {most} + 1, {most})) AS cuts FROM f{n} WHERE i <= len(s))),
whole{n} AS (SELECT doc_key, CASE WHEN cur <> '' THEN list_append(parts, cur) ELSE parts END AS parts FROM f{n} WHERE i > len(s)
 UNION ALL SELECT doc_key, [t] FROM d{n} WHERE t <> '' AND length(t) <= {most}),
each{n} AS (SELECT doc_key, doc_name, len(parts) AS total_parts, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS part_index FROM whole{n} JOIN d{n} USING (doc_key)),
named{n} AS (SELECT *, 'doc_' || left(sha1(coalesce(doc_name, 'None') || chr(10) || doc_key), 16) AS doc_id, greatest(1, length(text) // 4) AS token_estimate, coalesce(doc_name, '') AS nm, total_parts > 1 AS is_split FROM each{n}),
chunks{n} AS (SELECT *, 'chunk_' || left(sha1(doc_id || chr(10) || part_index || chr(10) || {_normal('text')}), 16) AS chunk_id, doc_key || '.txt' AS filename,
 CASE WHEN is_split THEN nm ELSE '' END AS heading_path_text, CASE WHEN is_split THEN (part_index + 1)::VARCHAR ELSE '' END AS point_number, doc_id || '_' || part_index AS point_id FROM named{n})"""


_MARKERS = r"(regexp_matches(text, '(?m)^\s*//') OR contains(text, '***') OR regexp_matches(text, '(?m)^\s*\\\s*$'))"
_TRUNCATED = rf"regexp_matches({_strip('text')}, '[:(,]$')"
_RULES = [
    ("nm = ''", "missing_doc_name", 25), ("heading_path_text = ''", "missing_heading_path_text", 20), (f"length({_strip('text')}) < 20", "too_short", 20), (_MARKERS, "service_markers", 15), (_TRUNCATED, "looks_truncated", 15),
    (r"point_number = '' AND regexp_matches(text, '^\s*(\{?\d+(?:[\.\-]\d+)*\}?|(?i)пункт)')", "missing_point_number", 10), ("length(text) > 1800", "too_long", 10), ("NOT is_split", "missing_required_payload_keys", 20),
]
_SCORED = f"""scored AS (SELECT doc_key, part_index, greatest(0, 100 - ({' + '.join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, _, p in _RULES)})) AS score,
 array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for c, k, _ in _RULES)}], lambda x: x IS NOT NULL), ',') AS codes FROM chunks)"""


def _report(name: str = "") -> str:
    """CTEs that end in report{name} (section, metric, value)."""
    n = name
    p = lambda col, q: f"coalesce((SELECT v FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS r, count(*) OVER () AS n FROM c{n}) WHERE r = round_even((n - 1) * {q}, 0)), 0)"
    one = [
        ("documents", "documents_total", "count(DISTINCT filename)"), ("documents", "chunks_without_doc_name", "count(*) FILTER (nm = '')"),
        ("documents", "duplicate_doc_ids", f"(SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM (SELECT filename, any_value(doc_id) AS doc_id FROM c{n} GROUP BY filename) GROUP BY doc_id))"),
        ("structure", "chunks_without_heading_path_text", "count(*) FILTER (heading_path_text = '')"), ("structure", "suspicious_long_headings", "count(*) FILTER (is_split AND length(nm) > 220)"), ("structure", "documents_without_headings", "count(DISTINCT filename) FILTER (NOT is_split)"),
        ("points", "points_detected", "count(DISTINCT point_id)"), ("points", "chunks_with_point_number", "count(*) FILTER (point_number <> '')"), ("points", "chunks_without_point_number", "count(*) FILTER (point_number = '')"), ("points", "split_chunks", "count(*) FILTER (is_split)"),
        ("points", "incomplete_point_chunks", "count(*) FILTER (is_split)"), ("points", "duplicate_point_ids", "count(*) FILTER (NOT is_split) - count(DISTINCT CASE WHEN NOT is_split THEN point_id END)"),
        ("chunks", "chunks_total", "count(*)"), ("chunks", "avg_chars", "coalesce(avg(length(text)), 0)"), ("chunks", "avg_token_estimate", "coalesce(avg(token_estimate), 0)"), ("chunks", "chunks_under_80_chars", "count(*) FILTER (length(text) < 80)"),
        ("chunks", "chunks_over_target", "count(*) FILTER (length(text) > 1600)"), ("chunks", "chunks_with_service_markers", f"count(*) FILTER ({_MARKERS})"), ("chunks", "chunks_look_truncated", f"count(*) FILTER ({_TRUNCATED})"),
        ("chunks", "duplicate_doc_point_text", f"(SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM c{n} GROUP BY doc_name, point_number, {_normal('text')}))"),
        ("chunks", "p95_chars", p("length(text)", 0.95)), ("chunks", "p95_token_estimate", p("token_estimate", 0.95)), ("chunks", "p50_chars", "median(length(text))"), ("chunks", "p50_token_estimate", "median(token_estimate)"),
        ("retrieval_readiness", "chunks_missing_required_payload_keys", "count(*) FILTER (NOT is_split)"), ("retrieval_readiness", "required_payload_keys_coverage", "1 - count(*) FILTER (NOT is_split) / count(*)"),
        ("retrieval_readiness", "empty_text_chunks", f"count(*) FILTER ({_strip('text')} = '')"), ("retrieval_readiness", "duplicate_chunk_ids", "count(*) - count(DISTINCT chunk_id)"),
    ]
    meta = [("documents_evaluated", "count(*)"), ("avg_score", "coalesce(avg(score), 0)"), ("min_score", "min(score)"), *((f"missing_{k}", f"count(*) FILTER (NOT {k})") for k in ("doc_name", "doc_title_full", "doc_kind", "doc_number", "doc_date", "authority", "approving_act"))]
    return f"""c{n} AS (SELECT * FROM chunks{n}), {_metadata(n)},
report{n} AS ({' UNION ALL '.join(f"SELECT '{s}' AS section, '{m}' AS metric, ({e})::DOUBLE AS value{'' if e.startswith(('(SELECT', 'coalesce((SELECT')) else f' FROM c{n}'}" for s, m, e in one)}
 UNION ALL {' UNION ALL '.join(f"SELECT 'metadata_quality', '{m}', ({e})::DOUBLE FROM meta{n}" for m, e in meta)}
 UNION ALL SELECT 'metadata_confidence', CASE WHEN is_split THEN 'high' ELSE '(empty)' END, count(*)::DOUBLE FROM c{n} GROUP BY ALL)"""


def _metadata(n: str = "") -> str:
    flags = {"doc_name": "nm <> ''", "doc_title_full": f"length({_strip(chr(39) + 'Source ' + chr(39) + ' || nm || ' + chr(39) + ' of texts' + chr(39))}) >= 12", "doc_kind": "is_split", "doc_number": "nm <> ''", "doc_date": "FALSE", "authority": "nm <> ''", "approving_act": "FALSE"}
    return f"""first{n} AS (SELECT DISTINCT filename, nm, is_split FROM chunks{n}),
meta{n} AS (SELECT filename, {', '.join(f'({e}) AS {k}' for k, e in flags.items())}, round(100.0 * ({' + '.join(f'({e})::INT' for e in flags.values())}) / 7, 2) AS score FROM first{n})"""


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\pL\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda x: x <> ''))"
_NEAR = """near AS (SELECT q.vec_id AS qid, v.vec_id AS cid, v.label, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s, q.label = v.label AS same FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS rank FROM near QUALIFY rank <= 10),
alike AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid) AS rank FROM near WHERE same QUALIFY rank <= 5)"""
_HITS = f"""{_NEAR}, hits AS (SELECT h.qid, tool, rank, s, cid::VARCHAR AS chunk_id, 'label ' || e.label AS doc_name, cid::VARCHAR AS point_number, 'vector ' || cid AS text FROM
 (SELECT qid, 'vector' AS tool, rank, round(s, 6) AS s, cid FROM top UNION ALL SELECT qid, 'payload', rank, round(s, 6), cid FROM alike UNION ALL SELECT vec_id, 'point', 1, NULL, vec_id FROM embeddings WHERE vec_id % 50 = 0) h JOIN embeddings e ON e.vec_id = h.cid)"""
_FUSED = """fused AS (SELECT qid, chunk_id, coalesce(sum(1.0 / (60 + rank)) FILTER (tool = 'point'), 0) + coalesce(sum(1.0 / (60 + rank)) FILTER (tool = 'payload'), 0) + coalesce(sum(1.0 / (60 + rank)) FILTER (tool = 'vector'), 0) AS sc,
 max(rank) FILTER (tool = 'point') AS point_rank, max(rank) FILTER (tool = 'payload') AS payload_rank, max(rank) FILTER (tool = 'vector') AS vector_rank FROM hits GROUP BY qid, chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, chunk_id) AS rank FROM fused)"""


def _catalog_text(x: str) -> str:
    return _squeeze(rf"regexp_replace(replace(lower({x}), 'ё', 'е'), '[^\pL\p{{M}}\p{{Nd}}\p{{Pc}}\s]+', ' ', 'g')")


def _first_words(x: str, n: int) -> str:
    return f"CASE WHEN len(string_split({x}, ' ')) >= {n} THEN array_to_string(string_split({x}, ' ')[1:{n}], ' ') ELSE '' END"


_ENTRIES = f"""names AS (SELECT p_name AS doc_name, {_catalog_text('p_name')} AS norm, {_catalog_text("'N 17 ' || p_name")} AS file_norm FROM (SELECT DISTINCT p_name FROM part)),
initials AS (SELECT *, list_filter(regexp_extract_all(doc_name, '[A-Za-z0-9]+'), lambda w: length(w) > 2) AS w FROM names),
entries AS (SELECT doc_name, norm, list_filter(list_distinct_in_order, lambda a: a <> '') AS aliases FROM (SELECT *, list_filter(l, lambda a, i: list_position(l, a) = i) AS list_distinct_in_order FROM
 (SELECT *, [norm, file_norm, CASE WHEN len(w) >= 2 THEN lower(array_to_string(list_transform(w[1:6], lambda x: left(x, 1)), '')) ELSE '' END, 'приказ 17', '17', {_first_words('norm', 4)}, {_first_words('norm', 6)}] AS l FROM initials)))"""
_ROOTS = "list_transform(list_filter(string_split({}, ' '), lambda w: length(w) > 3), lambda w: substr(w, 1, greatest(4, length(w) - 2)))"
#: Each alias, in order; the first that is named or overlaps decides.
_CANDIDATES = f"""{_ENTRIES}, asked AS (SELECT DISTINCT p_type || ' ' || p_name AS qid FROM part), q AS (SELECT qid, {_catalog_text('qid')} AS q FROM asked),
pairs AS (SELECT qid, q, doc_name, norm, unnest(aliases) AS a, generate_subscripts(aliases, 1) AS i FROM q, entries),
tried AS (SELECT *, {_ROOTS.format('a')} AS r FROM pairs),
over AS (SELECT *, CASE WHEN contains(q, a) OR contains(a, q) THEN 0.35 WHEN len(r) >= 2 AND len(list_filter(r, lambda x: contains(q, x))) / len(r) >= 0.7 THEN 0.6 * len(list_filter(r, lambda x: contains(q, x))) / len(r) END AS hit FROM tried),
cand AS (SELECT qid, doc_name, round(CASE WHEN contains(any_value(norm), any_value(q)) THEN 0.45 ELSE 0 END + CASE WHEN contains(any_value(q), any_value(norm)) THEN 0.35 ELSE 0 END + coalesce(arg_min(hit, i) FILTER (hit IS NOT NULL), 0), 6)::DOUBLE AS score FROM over GROUP BY qid, doc_name),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_name) AS rank FROM cand WHERE score > 0 QUALIFY rank <= 8)"""

_BLOCKING = [
    ("documents_total", "no_documents_processed", "rtf_processing"), ("chunks_missing_required_payload_keys", "missing_required_payload_keys", "payload_compatibility"), ("empty_text_chunks", "empty_text_chunks", "chunk_splitting"), ("duplicate_chunk_ids", "duplicate_chunk_ids", "chunk_splitting"),
    ("chunks_with_service_markers", "service_markers_in_text", "rtf_processing"), ("chunks_without_doc_name", "missing_doc_name", "metadata_extraction"), ("chunks_without_heading_path_text", "missing_heading_path_text", "heading_parsing"), ("duplicate_point_ids", "duplicate_point_ids", "point_parsing"),
]
_COMPARED = [
    ("documents_total", "documents_total", 1, True), ("chunks_total", "chunks_total", 1, False), ("chunks_without_doc_name", "chunks_without_doc_name", -1, True), ("chunks_without_heading_path_text", "chunks_without_heading_path_text", -1, True),
    ("chunks_without_point_number", "chunks_without_point_number", -1, True), ("duplicate_doc_point_text", "duplicate_doc_point_text", -1, True), ("service_markers", "chunks_with_service_markers", -1, True), ("document_metadata_avg_score", "avg_score", 1, True),
    *((f"documents_missing_{k}", f"missing_{k}", -1, True) for k in ("doc_kind", "doc_date", "authority", "approving_act")),
]
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_METRICS = {
    "top1_doc_match": ("TRUE", "rank = 1 AND lower(doc_name) = lower(want)"), "top5_doc_match": ("TRUE", "lower(doc_name) = lower(want)"),
    "top1_point_match": ("label < 5", "rank = 1 AND point_number = qid::VARCHAR"), "top5_chunk_match": ("FALSE", "FALSE"),
}

ORACLES: dict[str, str] = {
    "paragraphs_clean": f"WITH {_paragraphs(_LINES)} SELECT doc_key, ord, paragraph_index, md5(text) AS text_md5, level AS heading_level, point AS point_number, char_start, char_end FROM p",
    "heading_paths": f"{_PATHS} SELECT doc_key, ord, level AS heading_level, md5(array_to_string(path, ' > ')) AS path_md5 FROM paths",
    "point_units": f"""{_PATHS}, numbered AS (SELECT *, sum((level IS NOT NULL OR point <> '')::INT) OVER (PARTITION BY doc_key ORDER BY ord) AS unit FROM paths),
u AS (SELECT doc_key, unit, {_strip("string_agg(text, chr(10) ORDER BY ord)")} AS text, arg_min(path, ord) AS path, arg_min(point, ord) AS point, arg_min(paragraph_index, ord) AS chunk_start, arg_min(char_start, ord) AS char_start, arg_max(char_end, ord) AS char_end FROM numbered WHERE level IS NULL GROUP BY doc_key, unit)
SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY unit) - 1 AS chunk_index, md5(text) AS text_md5, md5(array_to_string(path, ' > ')) AS path_md5, coalesce(nullif(point, ''), {_point('text')}) AS point_number, chunk_start, char_start, char_end FROM u WHERE text <> ''""",
    "marked_text": f"WITH {_paragraphs(_TURNS)} SELECT doc_key, md5({_strip('''string_agg(CASE WHEN level > 0 THEN repeat('#', level) || ' ' || text || ' ' || repeat('#', level) ELSE text END, chr(10) ORDER BY ord)''')} || chr(10)) AS marked_md5 FROM p GROUP BY doc_key",
    "html_paragraphs": r"""WITH b AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?s)<h[1-6](?: [^>]*)?>.*?</h[1-6]>|<p(?: [^>]*)?>.*?</p>') AS l FROM pages),
e AS (SELECT page_id AS doc_key, unnest(l) AS block, generate_subscripts(l, 1) - 1 AS ord FROM b)
SELECT doc_key, ord, CASE WHEN block[2] = 'h' THEN block[3]::INT ELSE 10 END AS outline_level, md5(replace(replace(replace(replace(replace(replace(regexp_replace(block, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS text_md5 FROM e""",
    "split_chunks": f"WITH RECURSIVE {_chunks()} SELECT doc_key, part_index, total_parts, md5(text) AS text_md5, token_estimate, chunk_id, doc_id FROM chunks",
    "index_point_ids": f"""WITH RECURSIVE {_chunks()}, h AS (SELECT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('textloom:chunk:' || chunk_id)) AS h FROM chunks)
SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS index_id FROM h""",
    "token_estimate_stats": f"""WITH RECURSIVE {_chunks()}, r AS (SELECT nm, token_estimate AS v, row_number() OVER (PARTITION BY nm ORDER BY token_estimate) - 1 AS r, count(*) OVER (PARTITION BY nm) AS n FROM chunks)
SELECT nm AS doc_name, max(v) FILTER (r = round_even((n - 1) * 0.5, 0)) AS p50, max(v) FILTER (r = round_even((n - 1) * 0.95, 0)) AS p95 FROM r GROUP BY nm""",
    "chunk_penalties": f"WITH RECURSIVE {_chunks()}, {_SCORED} SELECT doc_key, part_index, score, codes FROM scored",
    "worst_chunks": f"WITH RECURSIVE {_chunks()}, {_SCORED} SELECT doc_key, part_index, score FROM scored ORDER BY score, doc_key, part_index LIMIT 20",
    "quality_report": f"WITH RECURSIVE {_chunks()}, {_report()} SELECT section, metric, round(value, 6) AS value FROM report",
    "blocking_defects": f"""WITH RECURSIVE {_chunks()}, {_report()}, rules(position, metric, code, stage) AS (VALUES {_values([(i, *r) for i, r in enumerate(_BLOCKING)])})
SELECT position, code, stage, CASE WHEN metric = 'documents_total' THEN 1 ELSE value::BIGINT END AS n FROM report JOIN rules USING (metric) WHERE CASE WHEN metric = 'documents_total' THEN value = 0 ELSE value > 0 END""",
    "duplicate_text": f"WITH RECURSIVE {_chunks()} SELECT left(sha1({_normal('text')}), 12) AS text_hash, count(*) AS copies, min(chunk_id) AS first_chunk FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "metadata_quality": f"WITH RECURSIVE {_chunks()}, {_metadata()} SELECT filename, score, doc_kind AS doc_kind_ok, authority AS authority_ok, approving_act AS approving_act_ok FROM meta",
    "baseline_compare": f"""WITH RECURSIVE {_chunks()}, {_chunks(800, '2')}, {_report()}, {_report('2')}, rules(metric, name, sign, gate) AS (VALUES {_values([(m, k, s, g) for k, m, s, g in _COMPARED])})
SELECT name AS metric, round(a.value, 6) AS new_value, round(b.value, 6) AS baseline_value, round(sign * (a.value - b.value), 6) + 0.0 AS delta, sign * (a.value - b.value) >= 0 AS passes, gate FROM rules JOIN report a USING (metric) JOIN report2 b USING (metric)""",
    "size_diverse_sample": """WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id AS id, n_chars AS size, k AS place FROM r, range(10) t(k) WHERE r = (k * (n - 1)) // 9""",
    "filter_must": f"""WITH RECURSIVE {_chunks()} SELECT doc_key, part_index FROM chunks WHERE doc_name IN ('SRC1', 'src2', 'SRC2', 'src3', 'SRC3') AND list_contains({_TOKENS.format('heading_path_text')}, 'src2')
 AND (list_contains({_TOKENS.format('text')}, 'the') OR list_contains({_TOKENS.format('heading_path_text')}, 'the') OR doc_name = 'the' OR filename = 'the')""",
    "payload_search": f"""WITH RECURSIVE {_chunks()}, t AS (SELECT chunk_id, doc_name, {_TOKENS.format('text')} AS own FROM chunks), b AS (SELECT item_id AS qid, {_TOKENS.format('text')} AS want FROM benchmark),
m AS (SELECT DISTINCT qid, chunk_id, coalesce(doc_name, '') AS doc_name FROM b, t WHERE list_has_all(own, want)), h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('textloom:chunk:' || chunk_id)) AS h FROM m)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY h[1:12] || '5' || h[14:16] || CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || h[18:32]) AS rank, chunk_id, doc_name FROM h QUALIFY rank <= 5""",
    "point_lookup": """WITH h AS (SELECT conv_id AS qid, 'turn-' || conv_id || '-' || turn AS chunk_id, turn::VARCHAR AS point_number, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('textloom:chunk:turn-' || conv_id || '-' || turn)) AS h FROM conversations WHERE turn IN (1, 2))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY h[1:12] || '5' || h[14:16]) AS rank, chunk_id, point_number FROM h""",
    "vector_topk": f"WITH {_NEAR} SELECT qid, cid AS chunk_id, round(s, 6) AS score, rank FROM top",
    "vector_topk_filtered": f"WITH {_NEAR} SELECT qid, cid AS chunk_id, round(s, 6) AS score, rank FROM alike",
    "rrf_fusion": f"WITH {_HITS}, {_FUSED} SELECT qid, chunk_id, round(sc, 8) AS rrf_score, rank, point_rank, payload_rank, vector_rank FROM ranked",
    "hybrid_eval": f"""WITH {_HITS}, {_FUSED}, lists AS (SELECT qid, tool, rank, doc_name, point_number FROM hits UNION ALL SELECT qid, 'hybrid', r.rank, 'label ' || e.label, chunk_id FROM ranked r JOIN embeddings e ON e.vec_id = r.chunk_id::BIGINT),
asked AS (SELECT vec_id AS qid, label, 'label ' || label AS want, p AS pipeline FROM embeddings, (VALUES ('point'), ('payload'), ('vector'), ('hybrid')) v(p) WHERE vec_id % 50 = 0),
got AS (SELECT a.qid, pipeline, any_value(label) AS label, {', '.join(f'coalesce(bool_or({c}), FALSE) AS {m}' for m, (_, c) in _METRICS.items())} FROM (SELECT a.*, rank, doc_name, point_number FROM asked a LEFT JOIN lists l ON l.qid = a.qid AND l.tool = a.pipeline AND l.rank <= 5) a GROUP BY a.qid, pipeline)
{' UNION ALL '.join(f"SELECT pipeline, '{m}' AS metric, count(*) FILTER (({w}) AND {m}) AS passed, count(*) FILTER ({w}) AS scored FROM got GROUP BY pipeline" for m, (w, _) in _METRICS.items())}""",
    "multi_query_merge": f"""WITH {_HITS}, l AS (SELECT *, CASE tool WHEN 'vector' THEN 0 ELSE 1 END AS query_no FROM hits WHERE tool <> 'point'), f AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY query_no, rank) AS k FROM l)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY query_no, rank) AS rank, chunk_id, query_no FROM f WHERE k = 1""",
    "score_rerank": f"WITH {_HITS} SELECT qid, tool, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY coalesce(s, 0) DESC, CASE tool WHEN 'point' THEN 0 WHEN 'payload' THEN 1 ELSE 2 END, chunk_id) AS rerank FROM hits QUALIFY rerank <= 8",
    "validate_citations": f"""WITH {_HITS}, c AS (SELECT qid, rank AS pos, doc_name, chunk_id, CASE rank WHEN 2 THEN 'missing_chunk_id' WHEN 3 THEN 'unknown_chunk_id' WHEN 4 THEN 'doc_name_mismatch' WHEN 5 THEN 'point_number_mismatch' ELSE 'valid' END AS status FROM hits WHERE tool = 'vector')
SELECT qid, pos, status, CASE WHEN status = 'valid' THEN doc_name END AS doc_name, CASE WHEN status = 'valid' THEN chunk_id END AS point_number,
 CASE pos WHEN 2 THEN 'citation[2]: missing chunk_id' WHEN 3 THEN 'citation[3]: unknown chunk id none' WHEN 4 THEN 'citation[4]: doc name mismatch other' WHEN 5 THEN 'citation[5]: point number mismatch 0.0' END AS warning FROM c""",
    "evidence_summary": f"""WITH {_HITS} SELECT qid, md5('Evidence summary for query: question ' || qid || chr(10) || chr(10) || string_agg(rank || '. ' || doc_name || ' ' || point_number || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS answer_md5 FROM hits WHERE tool = 'vector' AND rank <= 3 GROUP BY qid""",
    "answer_eval": f"""WITH {_HITS}, r AS (SELECT qid, count(*) AS items, count(*) FILTER (s > 0.5) AS cited, qid % 100 = 0 AS empty, CASE WHEN qid % 200 = 0 THEN 1 ELSE 0 END AS warned FROM hits GROUP BY qid)
SELECT count(*) AS questions_total, sum(items)::BIGINT AS items_returned_total, sum(cited)::BIGINT AS citations_total, sum(warned)::BIGINT AS citation_warnings_total, sum(2 * warned)::BIGINT AS warnings_total, sum(warned)::BIGINT AS fallback_total, count(*) FILTER (empty) AS empty_answer_count,
 round(count(*) FILTER (empty) / count(*), 4) AS empty_answer_rate, round(sum(2 * warned) / count(*), 4) AS avg_warnings_per_question, round(sum(warned) / count(*), 4) AS avg_fallbacks_per_question FROM r""",
    "catalog_aliases": f"WITH {_ENTRIES} SELECT doc_name, array_to_string(aliases, '|') AS aliases, '17' AS order_numbers FROM entries",
    "catalog_score_exact": f"WITH {_CANDIDATES} SELECT qid, doc_name, score, rank FROM best",
    "resolve_document": f"""WITH {_CANDIDATES}, two AS (SELECT qid, max(doc_name) FILTER (rank = 1) AS top_name, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM best GROUP BY qid)
SELECT qid, top_name, least(1.0::DOUBLE, a) AS confidence, coalesce(a - b < 0.08::DOUBLE, FALSE) AS ambiguous, CASE WHEN NOT coalesce(a - b < 0.08::DOUBLE, FALSE) AND least(1.0::DOUBLE, a) >= 0.55::DOUBLE THEN top_name END AS resolved_name FROM two""",
    "route_plan": """SELECT doc_id AS qid, array_to_string(list_filter([CASE WHEN scope THEN 'point' END, CASE WHEN asked OR scope THEN 'payload' END, CASE WHEN asked THEN 'vector' END], lambda x: x IS NOT NULL), ',') AS tools
FROM (SELECT doc_id, coalesce(lang <> 'en', FALSE) AS scope, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AS asked FROM documents)""",
    "windowed_events": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n_events, sum(round(value * 100)::BIGINT)::BIGINT AS total_cents FROM events GROUP BY ALL",
}

# Literals that the queries ask about, as the given tables have nothing like them; results by the rules' definitions.
_REGISTRATIONS = """SELECT * FROM (VALUES
 (1, 'order', 'приказ', '345', '12.05.2010', 'Министерство энергетики Российской Федерации'), (2, 'unknown', 'не классифицировано', '35-ФЗ', '', ''),
 (3, 'law', 'федеральный закон', '', '', 'Федеральное Собрание Российской Федерации; Президент Российской Федерации'), (4, 'law', 'федеральный закон', '250-ФЗ', '4 ноября 2007', 'Федеральное Собрание Российской Федерации; Президент Российской Федерации'),
 (5, 'gost', 'ГОСТ', '12.0.004-2015', '15 мая 1981', 'Федеральное агентство по техническому регулированию и метрологии (Росстандарт)'), (6, 'decree', 'постановление', '17-а', '1.2.2003', 'Правительство Российской Федерации'),
 (7, 'pue', 'приказ', '204', '8 июля 2002', 'Министерство энергетики Российской Федерации'), (8, 'unknown', 'не классифицировано', '', '', '')) v(id, kind, label, number, date, authority)"""
_ORDERS = """o AS (SELECT doc_id AS k, source, doc_id % 9 + 1 AS ch, doc_id % 3 = 0 AS bare, CASE WHEN doc_id % 3 = 0 THEN 'без номера' ELSE 'от 12.05.2010 № ' || doc_id || '-р' END AS line, 'Об утверждении Правил хранения ' || source AS name FROM documents),
m AS (SELECT *, CASE WHEN bare THEN 'Не указано' ELSE 'Приказ ' || line END AS reg, 'reg:' || CASE WHEN bare THEN 'not_extracted' ELSE 'initial_lines_header' END || ';title:initial_lines_title' AS src FROM o)"""
_UNITS = f"""{_ORDERS}, u AS (SELECT k, name, reg, 0 AS i, 0 AS start, '' AS point, NULL AS ch, '' AS head, 'ПРИКАЗ' || chr(10) || line || chr(10) || name AS text FROM m
 UNION ALL SELECT k, name, reg, 1, 4, '1', ch, 'Глава ' || ch || '. Общие', '1. Первый пункт о хранении' FROM m UNION ALL SELECT k, name, reg, 2, 5, '2', ch, 'Глава ' || ch || '. Общие', '2. Второй пункт о ' || source FROM m),
k1 AS (SELECT *, 'doc_' || left(sha1(name || chr(10) || reg || chr(10) || '/in/' || k), 16) AS doc_id, CASE WHEN point = '' THEN '__unnumbered__' ELSE point END || '::' || CASE WHEN head = '' THEN '__no_heading__' ELSE head END || '::' || start || ':' || i AS key FROM u),
k2 AS (SELECT *, 'point_' || left(sha1(doc_id || chr(10) || key), 16) AS point_id FROM k1)"""
_INDEX_ID = "h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32]"
_RECORDS = f"""h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('textloom:chunk:' || vec_id)) AS h FROM embeddings), rec AS (SELECT *, {_INDEX_ID} AS id FROM h)"""
_VERIFY = [
    ("chunks", "chunks_total", "count(*)"), ("chunks", "chunks_missing_required_payload_keys", "count(*) FILTER (NOT is_split)"), ("chunks", "required_payload_keys_coverage", "count(*) FILTER (is_split) / count(*)"), ("chunks", "payload_errors", "0 * count(*)"), ("chunks", "duplicate_index_ids", "count(*) - count(DISTINCT chunk_id)"),
    ("vector_readiness", "chunks_with_text", f"count(*) FILTER ({_strip('text')} <> '')"), ("vector_readiness", "empty_text_chunks", f"count(*) FILTER ({_strip('text')} = '')"), ("payload_lookup_readiness", "chunks_with_filename", "count(*)"), ("payload_lookup_readiness", "chunks_with_doc_name", "count(*) FILTER (nm <> '')"),
    ("payload_lookup_readiness", "chunks_with_heading_path_text", "count(*) FILTER (heading_path_text <> '')"), ("point_lookup_readiness", "chunks_with_chunk_id", "count(*)"), ("point_lookup_readiness", "chunks_with_point_identity_key", "0 * count(*)"), ("point_lookup_readiness", "chunks_with_point_number", "count(*) FILTER (point_number <> '')"),
]
_VERIFIED = "v AS (" + " UNION ALL ".join(f"SELECT '{s}' AS section, '{m}' AS metric, round(({e})::DOUBLE, 6) AS value FROM chunks" for s, m, e in _VERIFY) + ")"
_SMALL = f"""{_chunks(800, '0')}, {_chunks(1600, '1')}, chunks AS (SELECT * FROM chunks0 WHERE doc_key % 7 <> 0), chunks2 AS (SELECT * FROM chunks1 WHERE filename IN (SELECT filename FROM chunks)), {_report()}, {_report('2')}"""

# Questions with and without a point number against part names, part types and a few literals.
_SHARE = "coalesce(len(list_filter(string_split({0}, ' '), lambda w: length(w) >= 4 AND contains({1}, w))) / nullif(len(list_filter(string_split({0}, ' '), lambda w: length(w) >= 4)), 0), 0)"
_BEST = _CANDIDATES.replace("asked AS (SELECT DISTINCT p_type || ' ' || p_name AS qid FROM part)", "asked AS (SELECT DISTINCT p_type || ' ' || p_name AS qid FROM part UNION SELECT DISTINCT 'пункт 7.1 ' || p_name FROM part)")
_KNOWN = f"""{_BEST}, kd AS (SELECT *, {_catalog_text('doc_name')} AS name, {_catalog_text('annotation')} AS note, {_catalog_text("doc_name || ' ' || annotation")} AS whole
 FROM (SELECT 'd' || min(p_partkey) AS doc_id, p_name AS doc_name, min(p_type) || ' goods made by ' || min(p_brand) AS annotation, min(p_partkey) AS pos FROM part GROUP BY p_name)),
kt AS (SELECT p_type AS label, {_catalog_text('p_type')} AS lab, min(p_partkey) AS pos FROM part GROUP BY p_type),
ka(short, expansion, pos) AS (VALUES ('red', 'bolt and gear of steel', 0), ('promo', 'widget', 1), ('x', 'ring', 2)),
kp(phrase, shown, pos) AS (VALUES ('economy bolt', 'Economy bolt', 0), ('ring', 'ring', 1)),
own AS (SELECT qid, doc_id, pos, contains(name, q) AS a, contains(q, name) AS b, {_SHARE.format('q', 'name')} AS o, contains(note, q) AS c, {_SHARE.format('q', 'note')} AS n FROM q, kd),
kc AS (SELECT qid, doc_id, pos, 0 AS family, 0 AS item, CASE WHEN a THEN 0.45 ELSE 0 END::DOUBLE + CASE WHEN b THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN o >= 0.5 THEN o * 0.5::DOUBLE ELSE 0 END + CASE WHEN c THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN n >= 0.45::DOUBLE THEN n * 0.45::DOUBLE ELSE 0 END AS score,
 array_to_string(list_filter([CASE WHEN a THEN 'doc_name_contains_query' END, CASE WHEN b THEN 'query_contains_doc_name' END, CASE WHEN o >= 0.5 THEN printf('doc_name_token_overlap:%.2f', o) END, CASE WHEN c THEN 'annotation_contains_query' END, CASE WHEN n >= 0.45::DOUBLE THEN printf('annotation_token_overlap:%.2f', n) END], lambda x: x IS NOT NULL), '|') AS why FROM own
 UNION ALL SELECT qid, doc_id, kd.pos, 1, 0, 0.72, 'topic_alias:economy bolt' FROM q, kd WHERE (contains(q, 'economy bolt') OR contains(q, 'economy')) AND contains(name, 'bolt') AND NOT contains(name, 'blue')
 UNION ALL SELECT qid, doc_id, kd.pos, 1, 1, 0.72, 'topic_alias:ring' FROM q, kd WHERE contains(q, 'ring') AND (contains(name, 'small') OR contains(name, 'red'))
 UNION ALL SELECT qid, doc_id, kd.pos, 2, ka.pos, 0.48, 'abbreviation:' || short FROM q, kd, ka WHERE length(short) >= 2 AND contains(q, short) AND (contains(whole, left(expansion, 40)) OR {_SHARE.format('expansion', 'whole')} >= 0.35::DOUBLE)
 UNION ALL SELECT qid, doc_id, kd.pos, 3, kt.pos, 0.42, 'term:' || lab FROM q, kd, kt WHERE length(lab) >= 5 AND contains(q, lab) AND contains(whole, lab)),
kw AS (SELECT *, max(score) OVER (PARTITION BY qid, doc_id) AS top, row_number() OVER (PARTITION BY qid, doc_id ORDER BY family, item) AS rn FROM kc WHERE score > 0),
kf AS (SELECT qid, doc_id, any_value(pos) AS pos, max(score) AS score, min(rn) FILTER (score = top) AS first, arg_min(family, rn) AS family, arg_min(item, rn) AS item FROM kw GROUP BY qid, doc_id),
kr AS (SELECT kf.qid, kf.doc_id, string_agg(why, '|' ORDER BY rn) AS reasons FROM kf JOIN kw USING (qid, doc_id) WHERE rn >= first GROUP BY ALL),
found AS (SELECT qid, doc_id, round(score, 4) AS score, reasons, row_number() OVER (PARTITION BY qid ORDER BY score DESC, family, item, pos) AS rank FROM kf JOIN kr USING (qid, doc_id) QUALIFY rank <= 12),
said AS (SELECT qid, 0 AS family, pos, label AS shown FROM q, kt WHERE length(lab) >= 5 AND contains(q, lab) UNION ALL SELECT qid, 1, pos, shown FROM q, kp WHERE contains(q, phrase) UNION ALL SELECT qid, 2, pos, expansion FROM q, ka WHERE contains(q, short)),
terms AS (SELECT q.qid, coalesce(list(shown ORDER BY family, pos) FILTER (shown IS NOT NULL), []) AS l FROM q LEFT JOIN said USING (qid) GROUP BY q.qid),
both_ AS (SELECT coalesce(b.qid, k.qid) AS qid, coalesce(b.doc_name, k.doc_name) AS doc_name, greatest(coalesce(b.score, 0), coalesce(k.score, 0)) AS score, CASE WHEN k.qid IS NULL THEN 'catalog' WHEN b.qid IS NULL THEN 'knowledge' ELSE 'catalog+knowledge' END AS source, coalesce(b.rank, k.rank + 1000000) AS place
 FROM best b FULL JOIN (SELECT found.*, doc_name FROM found JOIN kd USING (doc_id)) k ON b.qid = k.qid AND b.doc_name = k.doc_name),
merged AS (SELECT qid, 'c:' || doc_name AS catalog_id, doc_name, score, source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place) AS rank FROM both_)"""
_PLANS = f"""WITH {_KNOWN}, two AS (SELECT qid, count(*) AS n, max(doc_name) FILTER (rank = 1) AS top_name, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM merged GROUP BY qid),
r AS (SELECT terms.qid, l, n, top_name, least(1.0::DOUBLE, a) AS conf, coalesce(a - b < 0.08::DOUBLE, FALSE) AS amb, CASE WHEN starts_with(terms.qid, 'пункт') THEN '7.1' ELSE '' END AS hint FROM terms LEFT JOIN two USING (qid)),
p AS (SELECT *, CASE WHEN NOT amb AND conf >= 0.55::DOUBLE THEN top_name END AS res, array_to_string(list_concat([qid], l)[1:4], '|') AS asked FROM r)
SELECT qid, CASE WHEN hint <> '' THEN 'point_lookup' ELSE 'factual' END AS question_type, coalesce('c:' || top_name, '') AS catalog_id, coalesce(top_name, '') AS doc_name, coalesce(conf, 0)::DOUBLE AS confidence, amb AS ambiguous, coalesce(n, 0) AS candidates_total, 'deterministic' AS resolver,
 array_to_string(l[1:8], '|') AS concepts, coalesce(res, '') AS resolved_doc_names, hint AS point_number_hints, CASE WHEN res IS NOT NULL THEN hint ELSE '' END AS point_queries, asked AS payload_queries, asked AS vector_queries,
 CASE WHEN hint <> '' AND res IS NOT NULL THEN 'point|' ELSE '' END || 'payload|vector' AS selected_tools,
 CASE WHEN n IS NULL THEN 'no document candidates matched the query' WHEN amb THEN 'document resolution ambiguous; search will run without doc_name filter' WHEN res IS NULL THEN printf('document resolution confidence %.2f below threshold; search will run without doc_name filter', conf) ELSE '' END AS warnings FROM p"""

# Every vector whose id is divisible by 50 asks. A payload search that has no query is planned for a point, but skipped.
_RUNTIME = f"""{_NEAR}, a AS (SELECT vec_id AS qid, label, vec_id % 100 <> 0 AS asked, vec_id % 150 = 0 AS pointed, vec_id % 350 = 0 AS named, CASE WHEN vec_id % 200 = 50 THEN 'fast' WHEN vec_id % 400 = 150 THEN 'deep' ELSE 'balanced' END AS profile FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT *, CASE WHEN qid % 250 <> 0 THEN 3 WHEN profile = 'fast' THEN 5 WHEN profile = 'deep' THEN 20 ELSE 10 END AS lim, profile <> 'fast' AND asked AS fuses FROM a),
nr AS (SELECT r.qid, cid, row_number() OVER (PARTITION BY r.qid ORDER BY round(s, 12) DESC, cid::VARCHAR) AS rank, lim FROM near JOIN r ON near.qid = r.qid WHERE asked AND (NOT pointed OR cid = r.qid) AND (NOT named OR same) QUALIFY rank <= lim),
hits AS (SELECT qid, 'point' AS tool, 1 AS rank, qid AS cid FROM r WHERE pointed UNION ALL SELECT qid, 'payload', 1, qid FROM r WHERE asked UNION ALL SELECT qid, 'vector', rank, cid FROM nr),
fused AS (SELECT hits.qid, cid, coalesce(sum(1.0 / (60 + rank)) FILTER (tool = 'point'), 0) + coalesce(sum(1.0 / (60 + rank)) FILTER (tool = 'payload'), 0) + coalesce(sum(1.0 / (60 + rank)) FILTER (tool = 'vector'), 0) AS sc FROM hits GROUP BY hits.qid, cid),
items AS (SELECT qid, 'hybrid' AS tool, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, cid::VARCHAR) AS rank, cid, lim FROM fused JOIN r USING (qid) WHERE fuses QUALIFY rank <= lim
 UNION ALL SELECT qid, CASE WHEN pointed THEN 'point' ELSE 'payload' END, 1, qid, lim FROM r WHERE NOT fuses AND (asked OR pointed))"""

ORACLES |= {
    "comparison_defects": f"""WITH RECURSIVE {_SMALL}, rules(metric, code, stage) AS (VALUES {_values(_BLOCKING)}), compared(name, metric, sign, gate) AS (VALUES {_values(_COMPARED)}),
miss AS (SELECT count(DISTINCT filename) AS n FROM chunks1 WHERE filename NOT IN (SELECT filename FROM chunks))
SELECT code, stage, CASE WHEN metric = 'documents_total' THEN 1 ELSE value::BIGINT END AS n FROM report JOIN rules USING (metric) WHERE CASE WHEN metric = 'documents_total' THEN value = 0 ELSE value > 0 END
UNION ALL SELECT 'baseline_metric_failed:' || name, 'baseline_comparison', 1 FROM compared JOIN report a USING (metric) JOIN report2 b USING (metric) WHERE gate AND sign * (a.value - b.value) < 0
UNION ALL SELECT 'baseline_documents_missing_in_new', 'baseline_comparison', n FROM miss WHERE n > 0""",
    "baseline_scope": f"""WITH RECURSIVE {_chunks()} SELECT filename, bool_or(doc_key % 7 <> 0) AS in_new, bool_or(doc_key % 5 <> 0) AS in_baseline FROM chunks WHERE doc_key % 7 <> 0 OR doc_key % 5 <> 0 GROUP BY filename""",
    "registrations": _REGISTRATIONS,
    "document_metadata": f"""WITH {_ORDERS} SELECT k AS doc_key, name AS doc_name, reg AS doc_reg, src AS metadata_source, CASE WHEN bare THEN 'medium' ELSE 'high' END AS metadata_confidence, CASE WHEN bare THEN 'не классифицировано' ELSE 'приказ' END AS doc_kind,
 CASE WHEN bare THEN '' ELSE k || '-р' END AS doc_number, CASE WHEN bare THEN '' ELSE '12.05.2010' END AS doc_date, '' AS authority, '' AS manifest_kind FROM m""",
    "metadata_manifest": f"WITH {_ORDERS} SELECT k || '|a.txt' AS filename, md5('| ' || k || '/a.txt | title_fallback | ' || src || ' | ' || name || ' | ' || reg || ' |  |  |') AS line_md5 FROM m WHERE bare",
    "structured_chunks": f"""WITH {_UNITS} SELECT k AS doc_key, i AS chunk_index, 'chunk_' || left(sha1(doc_id || chr(10) || point_id || chr(10) || '0' || chr(10) || {_normal('text')}), 16) AS chunk_id, doc_id, point_id, md5(key) AS key_md5,
 coalesce(ch::VARCHAR, '') AS chapter_number, CASE WHEN ch IS NULL THEN '' ELSE 'Общие' END AS chapter_title, head AS retrieval_anchor_heading, point AS point_number, md5(replace(text, chr(10), ' ')) AS text_md5 FROM k2""",
    "structured_headings": """WITH d AS (SELECT doc_id, doc_id % 9 AS n, 'Раздел IV. Часть ' || source AS s, 'Глава ' || doc_id % 9 || '_2. О хранении.' AS c, CASE WHEN doc_id % 2 = 0 THEN 'Статья ' || doc_id % 9 || '. ' || lang END AS a, source, lang FROM documents)
SELECT doc_id, coalesce(a, 'Прочее') AS nearest_heading, s || ' > ' || c || ' > ' || coalesce(a, 'Прочее') AS heading_path_text, c AS chapter_heading, n || '.2' AS chapter_number, 'О хранении' AS chapter_title, s AS section_heading, 'IV' AS section_number, 'Часть ' || source AS section_title,
 coalesce(a, '') AS article_heading, CASE WHEN a IS NULL THEN '' ELSE n::VARCHAR END AS article_number, CASE WHEN a IS NULL THEN '' ELSE lang END AS article_title, coalesce(a, s) AS retrieval_anchor_heading FROM d WHERE source IS NOT NULL AND lang IS NOT NULL""",
    "point_records": f"WITH {_RECORDS} SELECT id, vec_id::VARCHAR AS chunk_id, 'vector ' || vec_id AS text, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first FROM rec",
    "index_postings": """WITH p AS (SELECT 'chunk_id' AS field, vec_id::VARCHAR AS value FROM embeddings UNION ALL SELECT 'point_number', vec_id::VARCHAR FROM embeddings UNION ALL SELECT 'filename', vec_id || '.txt' FROM embeddings UNION ALL SELECT 'doc_name', 'label ' || label FROM embeddings
 UNION ALL SELECT 'text', 'vector' FROM embeddings UNION ALL SELECT 'text', vec_id::VARCHAR FROM embeddings) SELECT field, value, count(*) AS n FROM p GROUP BY ALL""",
    "index_upsert": f"WITH {_RECORDS} SELECT id, vec_id::VARCHAR AS chunk_id, CASE WHEN label = 3 THEN 'new text' ELSE 'vector ' || vec_id END AS text FROM rec WHERE label <> 5",
    "index_schema_diff": "SELECT * FROM (VALUES ('filename', 'keyword', 'bigint', 'wrong_type'), ('point_identity_key', 'keyword', NULL, 'missing'), ('heading_path_text', 'text', NULL, 'missing')) v(field_name, expected_schema, actual_schema, problem)",
    "index_verify": f"WITH RECURSIVE {_chunks()}, {_VERIFIED} SELECT section, metric, value FROM v",
    "index_defects": f"""WITH RECURSIVE {_chunks()}, {_VERIFIED}, rules(position, metric, code, stage) AS (VALUES {_values([(i, *r) for i, r in enumerate(fixed.INDEX_DEFECTS)])})
SELECT position, code, stage, value::BIGINT AS n FROM v JOIN rules USING (metric) WHERE CASE WHEN metric = 'chunks_total' THEN value = 0 ELSE value > 0 END""",
    "knowledge_candidates": f"WITH {_KNOWN} SELECT qid, doc_id, score, reasons, rank FROM found",
    "matched_terms": f"WITH {_KNOWN} SELECT qid, array_to_string(l[1:12], '|') AS terms FROM terms",
    "merged_candidates": f"WITH {_KNOWN} SELECT qid, catalog_id, doc_name, score, source, rank FROM merged",
    "query_plans": _PLANS,
    "runtime_batch": f"WITH {_RUNTIME} SELECT qid, tool, rank, cid::VARCHAR AS chunk_id, 'label ' || e.label AS doc_name FROM items JOIN embeddings e ON e.vec_id = cid",
    "runtime_report": f"""WITH {_RUNTIME}, t AS (SELECT *, list_filter([CASE WHEN pointed THEN 'point' END, CASE WHEN asked OR pointed THEN 'payload' END, CASE WHEN asked THEN 'vector' END], lambda x: x IS NOT NULL) AS l FROM r), n AS (SELECT qid, count(*) AS n FROM items GROUP BY qid)
SELECT qid, profile, array_to_string(l, ',') AS tools, len(l) AS tools_planned, len(l) - CASE WHEN asked OR NOT pointed THEN 0 ELSE 1 END AS tools_succeeded, coalesce(n, 0) AS items_returned, CASE WHEN fuses THEN 'hybrid_rrf' ELSE '' END AS fusion, CASE WHEN len(l) = 0 THEN 'empty_tool_plan' ELSE '' END AS empty_reason,
 CASE WHEN len(l) = 0 THEN 'runtime requires a non-empty query or stable point filters' WHEN NOT asked THEN 'payload skipped: empty query list' ELSE '' END AS warnings FROM t LEFT JOIN n USING (qid)""",
}
# Every pipeline, whatever a question asks for; a search without text goes by the filters, in the order of index ids.
_COMPARED_LISTS = f"""{_RUNTIME}, {_RECORDS}, byf AS (SELECT r.qid, vec_id AS cid, row_number() OVER (PARTITION BY r.qid ORDER BY id) AS rank, lim FROM r JOIN rec ON rec.label = r.label WHERE NOT asked AND named AND NOT pointed QUALIFY rank <= lim),
l3 AS (SELECT qid, 'point' AS tool, 1 AS rank, qid AS cid FROM r WHERE pointed UNION ALL SELECT qid, 'payload', 1, qid FROM r WHERE asked OR pointed UNION ALL SELECT qid, 'payload', rank, cid FROM byf UNION ALL SELECT qid, 'vector', rank, cid FROM nr),
fs AS (SELECT qid, cid, coalesce(sum(1.0 / (60 + rank)) FILTER (tool = 'point'), 0) + coalesce(sum(1.0 / (60 + rank)) FILTER (tool = 'payload'), 0) + coalesce(sum(1.0 / (60 + rank)) FILTER (tool = 'vector'), 0) AS sc FROM l3 GROUP BY qid, cid),
lists AS (SELECT * FROM l3 UNION ALL SELECT fs.qid, 'hybrid', row_number() OVER (PARTITION BY fs.qid ORDER BY sc DESC, cid::VARCHAR) AS rank, cid FROM fs JOIN r ON r.qid = fs.qid QUALIFY rank <= lim),
named_ AS (SELECT lists.*, 'label ' || e.label AS doc_name, cid::VARCHAR AS point_number FROM lists JOIN embeddings e ON e.vec_id = cid),
wanted AS (SELECT r.qid, label, 'label ' || label AS want, p AS pipeline FROM r, (VALUES ('point'), ('payload'), ('vector'), ('hybrid')) v(p)),
got AS (SELECT w.qid, pipeline, any_value(label) AS label, {', '.join(f'coalesce(bool_or({c}), FALSE) AS {m}' for m, (_, c) in _METRICS.items())} FROM (SELECT w.*, rank, doc_name, point_number FROM wanted w LEFT JOIN named_ n ON n.qid = w.qid AND n.tool = w.pipeline AND n.rank <= 5) w GROUP BY w.qid, pipeline)"""
ORACLES |= {
    "retrieval_compare": f"""WITH {_COMPARED_LISTS} {' UNION ALL '.join(f"SELECT pipeline, '{m}' AS metric, count(*) FILTER (({w}) AND {m}) AS passed, count(*) FILTER ({w}) AS scored FROM got GROUP BY pipeline" for m, (w, _) in _METRICS.items())}""",
    "answer_pipeline": f"""WITH {_RUNTIME}, g AS (SELECT items.qid, count(*) AS n, string_agg(cid::VARCHAR, ',' ORDER BY rank) AS c, string_agg(rank || '. label ' || e.label || ' ' || cid || chr(10) || 'vector ' || cid, chr(10) || chr(10) ORDER BY rank) AS t FROM items JOIN embeddings e ON e.vec_id = cid GROUP BY items.qid)
SELECT r.qid, md5(CASE WHEN n IS NULL THEN 'No evidence found for the request.' ELSE 'Evidence summary for query: ' || CASE WHEN asked THEN 'vector ' || r.qid ELSE 'request' END || chr(10) || chr(10) || t END) AS answer_md5, coalesce(c, '') AS citations, coalesce(n, 0) AS items_returned, coalesce(n, 0) AS reranked_items,
 CASE WHEN NOT asked AND NOT pointed THEN 'runtime requires a non-empty query or stable point filters|no evidence items available for final answer' WHEN NOT asked THEN 'payload skipped: empty query list' ELSE '' END AS warnings FROM r LEFT JOIN g ON g.qid = r.qid""",
    "empty_reasons": """WITH a AS (SELECT vec_id AS qid, label, vec_id % 250 = 0 AS odd, vec_id % 100 <> 0 AS asked, vec_id % 150 = 0 AS pointed, vec_id % 350 = 0 AS named, CASE WHEN vec_id % 250 = 0 THEN 10 ELSE 3 END AS lim FROM embeddings WHERE vec_id % 50 = 0),
n AS (SELECT *, CASE WHEN odd THEN 0 WHEN asked OR pointed THEN 1 WHEN named THEN least(lim, (SELECT count(*) FROM embeddings e WHERE e.label = a.label)) ELSE 0 END AS n FROM a)
SELECT qid, n AS candidates, CASE WHEN n > 0 THEN '' WHEN odd OR asked OR pointed OR named THEN 'no_matches' ELSE 'empty_query_and_filters' END AS empty_reason FROM n""",
}
assert fixed.RRF_K == 60  # the SQL above has it written out
# Other ways to the same rows.
ORACLES |= {"payload_search_indexed": ORACLES["payload_search"], "index_upsert_committed": ORACLES["index_upsert"], "vector_topk_cells": ORACLES["vector_topk"]}
ORACLES["runtime_isolated"] = "SELECT vec_id AS qid, (vec_id <> 450)::BIGINT AS hits, vec_id = 450 AS failed FROM embeddings WHERE vec_id % 50 = 0"
ORACLES["catalog_entries"] = """WITH d AS (SELECT doc_id, trim(concat_ws(' ', 'N 7', source, 'in', lang)) AS doc_name, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE '' END AS own FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_name, min(doc_id) AS first, arg_min(own, doc_id) AS own FROM d GROUP BY doc_name)
SELECT CASE WHEN own <> '' THEN own ELSE 'doc_' || row_number() OVER (ORDER BY first, doc_name) END AS catalog_id, doc_name, first || '.txt' AS filename, own AS doc_id, '7' AS order_numbers FROM f"""
_TOP3 = f"{_NEAR}, t AS (SELECT qid, list(cid::VARCHAR ORDER BY rank)[1:3] AS t FROM top GROUP BY qid)"
ORACLES["reply_rerank"] = f"""WITH {_TOP3}, o AS (SELECT qid, CASE qid // 50 % 5 WHEN 0 THEN [t[3], t[1]] WHEN 1 THEN [t[2], t[1]] WHEN 2 THEN [t[3], t[2], t[1]] WHEN 3 THEN [t[2], t[3]] ELSE [] END AS ids FROM t)
SELECT qid, unnest(ids) AS chunk_id, generate_subscripts(ids, 1)::INTEGER AS rerank FROM o"""
ORACLES["reply_answers"] = f"""WITH {_TOP3}, k AS (SELECT *, qid // 50 % 7 AS k FROM t)
SELECT qid, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END AS answer, CASE k WHEN 0 THEN t[1] || ':|' || t[2] || ':' WHEN 1 THEN t[1] || ':|' || t[2] || ':|' || t[3] || ':' WHEN 2 THEN t[1] || ':D' ELSE '' END AS citations,
 CASE k WHEN 2 THEN 'citation[1]: missing chunk_id|citation[2]: unsupported citation type|citation[3]: empty chunk_id string' ELSE '' END AS warnings,
 CASE k WHEN 3 THEN 'answer must be a non-empty string' WHEN 4 THEN 'reply is not JSON' WHEN 5 THEN 'answer must be a non-empty string' WHEN 6 THEN 'citations must be a list or string' ELSE '' END AS error FROM k"""

"""SQL twins of the core queries, for an independent engine. Common table expressions are composed by name."""

from __future__ import annotations

from pagewright.functions.text import ABBREVIATIONS, REPLACED, STOP_TERMS

WS = r"[\s\x0B\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, '{WS}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"len({words(x)})"


def _normalized() -> str:
    t = r"regexp_replace(coalesce(raw_text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
    t = rf"regexp_replace({t}, '\r\n|\r', E'\n', 'g')"
    t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_]+)-\n([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"
    for a, b in REPLACED:
        t = f"replace({t}, '{a}', '{b}')"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', E'\n\n', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, ' +\n', E'\n', 'g'), '\n +', E'\n', 'g')"
    return strip(t)


def _sentences() -> str:
    t = "coalesce(text, '')"
    for a in ABBREVIATIONS:
        pattern, kept = a.replace(".", r"\."), a.replace(".", "\\x01")
        t = rf"regexp_replace({t}, '\b{pattern}', E'{kept}', 'g')"
    return rf"list_filter(list_transform(regexp_split_to_array({t}, '[.!?]+(?:{WS}+|$)'), lambda x: replace({strip('x')}, chr(1), '.')), lambda x: length(x) > 3)"


SCORE = rf"""CASE WHEN length(s) < 3 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (CASE WHEN length(s) > 150 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * (
 (CASE WHEN regexp_matches(s, '^[0-9]+(\.[0-9]+)*{WS}+[^\s]+') THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END)
 + (CASE WHEN upper(s) = s AND lower(s) <> s AND length(s) BETWEEN 5 AND 120 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
 + (CASE WHEN 2 * len(list_filter({words('s')}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) > {tokens('s')} AND length(s) < 100 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
 + (CASE WHEN NOT ends_with(s, '.') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END))) END"""

MAX, OVER, LEAST = 96, 16, 32


def _sections(source: str, least: float) -> str:
    """CTEs from a pages relation (page_id, doc_id, page_number, text, l) to `sec`."""
    return f"""
lin AS (SELECT doc_id, page_number, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS s FROM {source}),
sco AS (SELECT *, ({SCORE}) >= {least}::DOUBLE AS h FROM lin),
mar AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, pos) AS sec FROM sco),
hea AS (SELECT doc_id, CAST(sec - 1 AS INTEGER) AS section_idx, printf('sec_%03d', CAST(sec - 1 AS INTEGER)) AS section_id, {strip("first(s ORDER BY page_number, pos)")} AS title,
 min(page_number) AS page_start, max(page_number) AS page_end, string_agg(s, E'\\n' ORDER BY page_number, pos) AS text FROM mar WHERE sec > 0 GROUP BY doc_id, sec),
bar AS (SELECT doc_id, page_number, text, count(*) OVER (PARTITION BY doc_id) AS np, sum(len(l)) OVER (PARTITION BY doc_id) AS nl, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1 AS idx
 FROM {source} WHERE doc_id NOT IN (SELECT doc_id FROM hea)),
sec AS (SELECT doc_id, section_idx, section_id, title, CASE WHEN regexp_matches(title, '^[0-9]+\\.[0-9]+') THEN 2 ELSE 1 END AS sec_level, page_start, page_end, text FROM hea
 UNION ALL SELECT doc_id, CAST(idx AS INTEGER), CASE WHEN np = 1 THEN 'sec_001' ELSE printf('sec_page_%03d', page_number) END, CASE WHEN np = 1 THEN 'Document' ELSE printf('Page %d', page_number) END, 1, page_number, page_number, text FROM bar WHERE nl > 0)"""


def _stripped(threshold: float, least: int) -> str:
    """CTEs from `pag` to `str`, the pages without repeated headers and footers."""
    return f"""
edg AS (SELECT doc_id, 'header' AS zone, unnest(l[1:3]) AS line FROM pag WHERE len(l) >= 3 UNION ALL SELECT doc_id, 'footer', unnest(l[-3:]) FROM pag WHERE len(l) >= 3),
cnt AS (SELECT doc_id, zone, line, count(*) AS cnt FROM edg GROUP BY ALL),
rep AS (SELECT c.* FROM cnt c JOIN (SELECT doc_id, count(*) AS n FROM pag GROUP BY 1) USING (doc_id) WHERE cnt >= greatest(CAST(floor({threshold}::DOUBLE * n) AS INTEGER), {least})),
hf AS (SELECT doc_id, coalesce(list(line) FILTER (zone = 'header'), []) AS h, coalesce(list(line) FILTER (zone = 'footer'), []) AS f FROM rep GROUP BY 1),
lim AS (SELECT pag.*, coalesce(h, []) AS hh, coalesce(f, []) AS ff FROM pag LEFT JOIN hf USING (doc_id)),
bou AS (SELECT *, list_min(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(hh, l[i]))) AS a, list_max(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(ff, l[i]))) AS b FROM lim),
str AS (SELECT page_id, doc_id, page_number, kept AS l, array_to_string(kept, E'\\n') AS text FROM (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND b >= a THEN l[a:b] ELSE []::VARCHAR[] END AS kept FROM bou))"""


def _packed(source: str) -> str:
    """CTEs from sections to `chu` (doc_id, section_idx, ..., pos, text), by folds over the sentences."""
    toks = lambda x: f"CAST({tokens(x)} AS BIGINT)"
    return f"""
sen AS (SELECT doc_id, section_idx, arr, list_transform(arr, lambda x: {toks('x')}) AS n FROM (SELECT doc_id, section_idx, {_sentences()} AS arr FROM {source})),
fol AS (SELECT doc_id, section_idx, 0 AS i, []::VARCHAR[] AS done, 1 AS a, 0::BIGINT AS tot FROM sen
 UNION ALL
 SELECT doc_id, section_idx, i + 1, CASE WHEN full_ THEN list_append(done, array_to_string(arr[a:i], ' ')) ELSE done END, CASE WHEN full_ THEN i + 1 - keep ELSE a END,
  n[i + 1] + CASE WHEN full_ THEN coalesce(list_sum(n[i + 1 - keep:i]), 0)::BIGINT ELSE tot END
 FROM (SELECT f.*, s.arr, s.n, i >= a AND tot + s.n[i + 1] > {MAX} AS full_,
   coalesce(list_max(list_filter(range(0, i - a + 2), lambda m: coalesce(list_sum(s.n[i + 1 - m:i]), 0) <= {OVER})), 0) AS keep FROM fol f JOIN sen s USING (doc_id, section_idx) WHERE i < len(s.arr))),
raw AS (SELECT f.doc_id, f.section_idx, CASE WHEN len(arr) > 0 THEN list_append(done, array_to_string(arr[a:], ' ')) ELSE done END AS c FROM fol f JOIN sen s USING (doc_id, section_idx) WHERE i = len(arr)),
siz AS (SELECT *, list_transform(c, lambda x: {toks('x')}) AS n FROM raw),
mer AS (SELECT doc_id, section_idx, 0 AS i, []::VARCHAR[] AS out FROM siz
 UNION ALL
 SELECT doc_id, section_idx, CASE WHEN both_ THEN i + 2 ELSE i + 1 END, list_append(out, CASE WHEN both_ THEN c[i + 1] || ' ' || c[i + 2] ELSE c[i + 1] END)
 FROM (SELECT m.*, c, s.n, i + 2 <= len(c) AND s.n[i + 1] < {LEAST} AND s.n[i + 1] + s.n[i + 2] <= {MAX} * 1.2 AS both_ FROM mer m JOIN siz s USING (doc_id, section_idx) WHERE i < len(c))),
chu AS (SELECT m.doc_id, m.section_idx, unnest(range(0, len(out))) AS pos, unnest(out) AS text FROM mer m JOIN siz s USING (doc_id, section_idx) WHERE i = len(c)),
kep AS (SELECT doc_id, section_idx, CAST(pos AS INTEGER) AS pos, text, CAST({tokens('text')} AS INTEGER) AS token_count, CAST(length(text) AS INTEGER) AS char_count FROM chu
 WHERE length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(text) >= 0.3::DOUBLE)"""


PAG = f"pag AS (SELECT page_id, doc_id, page_number, text, list_filter(list_transform(string_split(text, E'\\n'), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM (SELECT page_id, doc_id, page_number, {_normalized()} AS text FROM (SELECT DISTINCT ON (page_id) * FROM pdf_pages)))"
DOC = "dsec AS (SELECT DISTINCT ON (doc_id, section_idx) * FROM doc_sections)"
PRS = "prs AS (SELECT DISTINCT ON (pair_id) * FROM pairs_df)"
VEC = "vec AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), qry AS (SELECT row_id AS query_id, e, label FROM vec WHERE row_id % 100 = 0)"
SIM = VEC + ", sim AS (SELECT query_id, row_id, list_dot_product(q.e, v.e) AS similarity, q.label AS ql, v.label AS rl FROM qry q, vec v)"
PVE = VEC + ", pai AS (SELECT a.row_id // 2 AS pair_id, a.e AS a, b.e AS b FROM vec a JOIN vec b ON b.row_id = a.row_id + 1 WHERE a.row_id % 2 = 0)"
LINES = "lines AS (SELECT page_id, doc_id, page_number, unnest(range(0, len(l))) AS pos, unnest(l) AS s FROM pag)"
LOSS = PVE + ", bat AS (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch FROM pai), z AS (SELECT x.batch, x.pair_id AS i, y.pair_id AS j, list_dot_product(x.a, y.b) / 0.5::DOUBLE AS z FROM bat x JOIN bat y USING (batch)), per AS (SELECT batch, i, max(z) AS m FROM z GROUP BY ALL), los AS (SELECT batch, i, max(m) + ln(sum(exp(z - m))) - max(z) FILTER (i = j) AS loss FROM z JOIN per USING (batch, i) GROUP BY ALL), bl AS (SELECT batch, avg(loss) AS loss FROM los GROUP BY ALL)"
SEC_KEYS = "doc_id, section_idx"
_stop = ", ".join(f"'{w}'" for w in STOP_TERMS)
_phrases = rf"""list_transform(list_filter(list_concat(regexp_extract_all(text, '["'']([^"'']+)["'']', 1), regexp_extract_all(text, '\(([^)]+)\)', 1)), lambda x: length(x) > 5 AND length(x) < 50), lambda x: {strip('x')})"""
_defined = rf"regexp_extract_all(text, '([A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*){WS}+(?:is|are){WS}+[^.,;]+', 1)"
TERMS = (
    DOC
    + rf""", cap AS (SELECT doc_id, section_idx, unnest(c) AS w, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, section_idx, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$')) AS c FROM dsec)),
top AS (SELECT doc_id, section_idx, w, row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY n DESC, i) AS r FROM (SELECT doc_id, section_idx, w, count(*) AS n, min(i) AS i FROM cap GROUP BY ALL)),
cap10 AS (SELECT doc_id, section_idx, list(w ORDER BY r) AS c FROM top WHERE r <= 10 AND w NOT IN ({_stop}) AND length(w) > 3 GROUP BY ALL),
trm AS (SELECT doc_id, section_idx, text, list_filter(t, lambda x, i: list_position(t, x) = i)[1:20] AS t FROM (SELECT d.doc_id, d.section_idx, coalesce(text, '') AS text, list_concat(coalesce(c, []), {_phrases}, {_defined}) AS t FROM dsec d LEFT JOIN cap10 USING (doc_id, section_idx)))"""
)


def _question(x: str) -> str:
    s = strip(x)
    is_, does = (f"regexp_extract({s}, '^([A-Z][^.!?]+?){WS}+{verb}{WS}+[^.!?]+', 1)" for verb in ("is", "(?:does|do|did)"))
    return f"CASE WHEN length({s}) < 10 THEN NULL WHEN {is_} <> '' THEN 'What is ' || {strip(is_)} || '?' WHEN {does} <> '' THEN 'How does ' || {strip(does)} || ' work?' WHEN {tokens(x)} > 3 THEN 'What is ' || array_to_string({words(x)}[1:3], ' ') || '?' END"


LONG = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+{WS}+'), lambda x: {strip('x')}), lambda x: length(x) > 20)"


def _asked(n: int) -> str:
    forms = """CASE (i - 1) % 6 WHEN 0 THEN 'What is ' || x || '?' WHEN 1 THEN 'How does ' || x || ' work?' WHEN 2 THEN 'What are the characteristics of ' || x || '?' WHEN 3 THEN 'Why is ' || x || ' important?'
 WHEN 4 THEN CASE WHEN i < len(t) THEN 'What is the relationship between ' || x || ' and ' || t[i + 1] || '?' ELSE 'What is ' || x || '?' END ELSE 'How is ' || x || ' used?' END"""
    return f""", ask AS (SELECT doc_id, section_idx, text, list_transform(t[1:{n}], lambda x, i: {forms}) AS q FROM trm),
qs AS (SELECT doc_id, section_idx, list_concat(q, list_filter(list_transform(({LONG})[1:greatest({n} - len(q), 0)], lambda y: {_question('y')}), lambda y: y IS NOT NULL))[1:{n}] AS q FROM ask)"""


#: Queries over chunks take the same composition with the chunk text as the section's.
CHUNKS = f"WITH RECURSIVE {DOC}, {_packed('dsec')}, full_ AS (SELECT k.doc_id, printf('%s::sec%03d::chunk%05d', k.doc_id, k.section_idx, pos) AS chunk_id, section_id, title AS section_title, page_start, page_end, token_count, char_count, k.text FROM kep k JOIN dsec d USING (doc_id, section_idx))"
EMB = lambda x: f"list_transform(range(0, 64), lambda d: coalesce(list_sum(list_transform(list_filter({x}, lambda h: h % 64 = d), lambda h: CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)), 0.0::DOUBLE))"
HASHES = lambda x: f"list_transform({words('lower(coalesce(' + x + ', ' + chr(39) * 2 + '))')}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT)"
SPLIT = f"{PRS}, grp AS (SELECT g, row_number() OVER (ORDER BY md5(g || '|42'), g) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT coalesce(chunk_id, chr(0)) AS g FROM prs)), spl AS (SELECT p.*, CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'train' END AS sp FROM prs p JOIN grp ON coalesce(chunk_id, chr(0)) = g)"

DOWN = "[" + ", ".join("[" + ", ".join(f"{((i + 2) * (j + 1) % 7 - 3) / 10}::DOUBLE" for j in range(64)) + "]" for i in range(2)) + "]"
UP = "[" + ", ".join("[" + ", ".join(f"{((i + 3) * (j + 1) % 5 - 2) / 10}::DOUBLE" for i in range(2)) + "]" for j in range(64)) + "]"
HITS = f"WITH {DOC}, {PRS}, qh AS (SELECT pair_id, {HASHES('query')} AS h FROM prs WHERE pair_id % 100 = 0), q AS (SELECT pair_id, {EMB('h')} AS v FROM qh), rh AS (SELECT printf('%s/%03d', doc_id, section_idx) AS row_id, text AS document, {HASHES('text')} AS h FROM dsec), r AS (SELECT row_id, document, {EMB('h')} AS v FROM rh), sim AS (SELECT pair_id AS query_id, row_id, document, round(list_dot_product(q.v, r.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-12) * greatest(sqrt(list_dot_product(r.v, r.v)), 1e-12)), 9) AS similarity FROM q, r), hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS rank FROM sim)"

SQL: dict[str, str] = {
    "normalize_text": f"WITH {PAG} SELECT page_id, text FROM pag",
    "split_lines": f"WITH {PAG}, {LINES} SELECT page_id, CAST(pos AS INTEGER) AS pos, s AS line FROM lines",
    "heading_score": f"WITH {PAG}, {LINES} SELECT page_id, CAST(pos AS INTEGER) AS pos, round({SCORE}, 6) AS score FROM lines",
    "detect_headings": f"WITH {PAG}, {LINES}, sc AS (SELECT *, {SCORE} AS score FROM lines) SELECT doc_id, page_number, CAST(pos AS INTEGER) AS pos, s AS line, round(score, 6) AS score FROM sc WHERE score >= 0.4::DOUBLE",
    "header_footer_candidates": f"WITH {PAG}, {_stripped(0.6, 0)} SELECT doc_id, zone, line, cnt FROM cnt",
    "strip_headers_footers": f"WITH {PAG}, {_stripped(0.6, 0)} SELECT page_id, text AS cleaned_text FROM str",
    "strip_repeated_only": f"WITH {PAG}, {_stripped(0.3, 2)} SELECT page_id, text AS cleaned_text FROM str",
    "build_sections": f"WITH {PAG}, {_sections('pag', 0.4)} SELECT * FROM sec",
    "page_sections_no_headings": f"WITH {PAG}, {_sections('pag', 0.75)} SELECT * FROM sec WHERE section_id LIKE 'sec_page%' OR section_id = 'sec_001' AND title = 'Document'",
    "split_sentences": f"WITH {DOC}, s AS (SELECT doc_id, section_idx, {_sentences()} AS a FROM dsec) SELECT doc_id, section_idx, CAST(unnest(range(0, len(a))) AS INTEGER) AS pos, unnest(a) AS sentence FROM s",
    "pack_chunks": f"WITH RECURSIVE {DOC}, {_packed('dsec')} SELECT doc_id, section_idx, CAST(pos AS INTEGER) AS pos, text, CAST({tokens('text')} AS INTEGER) AS tokens FROM chu",
    "chunk_table": f"{CHUNKS} SELECT * FROM full_",
    "noise_filter": f"WITH {PAG}, {LINES} SELECT page_id, CAST(pos AS INTEGER) AS pos, s AS line FROM lines WHERE length(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(s) < 0.6::DOUBLE",
    "chunk_stats": f"WITH RECURSIVE {PAG}, {_stripped(0.6, 2)}, {_sections('str', 0.4)}, {_packed('sec')} SELECT (SELECT count(*) FROM pag) AS num_pages, (SELECT count(*) FROM sec) AS num_sections, count(*) AS num_chunks, CAST(sum(token_count) AS BIGINT) AS total_tokens, round(avg(token_count), 6) AS avg_tokens_per_chunk, CAST(min(token_count) AS BIGINT) AS min_tokens, CAST(median(token_count) AS DOUBLE) AS median_tokens, CAST(max(token_count) AS BIGINT) AS max_tokens FROM kep",
    "pipeline_chunks": f"WITH RECURSIVE {PAG}, {_stripped(0.6, 2)}, {_sections('str', 0.4)}, {_packed('sec')} SELECT printf('%s::sec%03d::chunk%05d', doc_id, section_idx, pos) AS chunk_id, token_count, char_count, text FROM kep",
    "chunk_describe": f"{CHUNKS} SELECT count(token_count) AS count, round(avg(token_count), 6) AS mean, round(stddev_samp(token_count), 6) AS std, min(token_count) AS min, CAST(quantile_cont(token_count, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(token_count, 0.5) AS DOUBLE) AS q2, CAST(quantile_cont(token_count, 0.75) AS DOUBLE) AS q3, max(token_count) AS max FROM full_",
    "chunk_distincts": "SELECT count(DISTINCT section_id) AS sections, count(DISTINCT chunk_id) AS chunks, min(page_start) AS first_page, max(page_start) AS last_page FROM chunk_embeddings",
    "file_stems": r"SELECT DISTINCT source_pdf, regexp_extract(source_pdf, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem FROM doc_sections",
    "timing_breakdown": "SELECT event_type AS function_name, count(value) AS count, round(avg(value), 3) AS mean_sec, round(sum(value), 3) AS total_sec, round(min(value), 3) AS min_sec, round(max(value), 3) AS max_sec FROM events GROUP BY 1",
    "timing_extremes": "SELECT round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS longest, (SELECT event_type FROM events ORDER BY value DESC, event_type DESC LIMIT 1) AS slowest FROM events",
    "events_datetime": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events",
    "windowed_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "loss_improvement": "WITH d AS (SELECT date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS epoch, avg(value) AS loss FROM events GROUP BY 1), b AS (SELECT arg_min(loss, epoch) AS a, arg_max(loss, epoch) AS z FROM d) SELECT round(a, 6) AS first_loss, round(z, 6) AS last_loss, round(a - z, 6) AS improvement, round(100 * (a - z) / a, 6) AS improvement_pct FROM b",
    "parameter_counts": "SELECT CAST(sum(p_size) FILTER (p_partkey % 10 = 0) AS BIGINT) AS trainable, CAST(sum(p_size) AS BIGINT) AS total, round(100.0::DOUBLE * (sum(p_size) FILTER (p_partkey % 10 = 0)) / sum(p_size), 6) AS percent FROM part",
    "pair_aliases": f"WITH {PRS} SELECT coalesce(query, '') AS anchor, coalesce(passage, '') AS positive FROM prs",
    "validate_pairs": f"WITH {PRS} SELECT count(*) AS num_pairs, round(avg(length(coalesce(query, ''))), 6) AS avg_anchor_length, round(avg(length(coalesce(passage, ''))), 6) AS avg_positive_length, bool_or(trim(coalesce(query, ''), ' ') = '' OR trim(coalesce(passage, ''), ' ') = '') AS has_empty FROM prs",
    "key_terms": f"WITH {TERMS} SELECT doc_id, section_idx, CAST(unnest(range(0, len(t))) AS INTEGER) AS pos, unnest(t) AS term FROM trm",
    "heuristic_questions": f"WITH {TERMS}{_asked(6)} SELECT doc_id, section_idx, CAST(unnest(range(0, len(q))) AS INTEGER) AS pos, unnest(q) AS question FROM qs",
    "statement_to_question": f"WITH {DOC}, s AS (SELECT doc_id, section_idx, {LONG} AS a FROM dsec), u AS (SELECT doc_id, section_idx, CAST(unnest(range(0, len(a))) AS INTEGER) AS pos, unnest(a) AS x FROM s) SELECT doc_id, section_idx, pos, {_question('x')} AS question FROM u",
    "marked_questions": rf"WITH {DOC}, s AS (SELECT doc_id, section_idx, list_transform(list_filter(regexp_extract_all(text, '([^.!?]*\?)', 1), lambda x: length(x) > 10 AND {strip('x')} <> ''), lambda x: {strip('x')}) AS a FROM dsec) SELECT doc_id, section_idx, CAST(unnest(range(0, len(a))) AS INTEGER) AS pos, unnest(a) AS question FROM s",
    "build_pairs": CHUNKS.replace("WITH RECURSIVE", "WITH RECURSIVE", 1)
    + ", "
    + TERMS.replace(DOC + ", ", "", 1).replace("FROM dsec", "FROM csec").replace("cap10 AS", "cap10 AS").replace("doc_id, section_idx", "chunk_id").replace("d.chunk_id", "d.chunk_id").replace("d.doc_id, d.section_idx", "d.chunk_id").replace("cap AS", "csec AS (SELECT chunk_id, text FROM full_), cap AS", 1)
    + _asked(3).replace("doc_id, section_idx", "chunk_id")
    + " SELECT chunk_id, q.query, text AS passage, doc_id, token_count, char_count FROM (SELECT chunk_id, unnest(q) AS query FROM qs) q JOIN full_ USING (chunk_id)",
    "questions_per_chunk": f"WITH {PRS} SELECT round(count(*) / count(DISTINCT chunk_id), 6) AS avg_questions FROM prs",
    "grouped_split": f"WITH {SPLIT} SELECT pair_id, sp AS split_name FROM spl",
    "split_counts": f"WITH {SPLIT} SELECT sp AS split_name, count(*) AS num_pairs, count(DISTINCT chunk_id) AS num_groups FROM spl GROUP BY 1",
    "split_leak_check": f"WITH {PRS} SELECT CAST(count(*) FILTER (n > 1) AS BIGINT) AS num_leaks FROM (SELECT chunk_id, count(DISTINCT split_name) AS n FROM prs GROUP BY 1)",
    "union_roles": f"WITH {PRS} SELECT pair_id, 'anchor' AS role, query AS text FROM prs UNION ALL SELECT pair_id, 'positive', passage FROM prs",
    "unit_norm_check": f"WITH {VEC} SELECT bool_and(u) AS all_unit, count(*) FILTER (u) AS n_unit FROM (SELECT abs(sqrt(list_dot_product(e, e)) - 1) < 1e-5 AS u FROM vec)",
    "l2_normalize": f"WITH {VEC}, w AS (SELECT row_id, list_transform(e, lambda x: x * 2 + 0.01::DOUBLE) AS e FROM vec) SELECT row_id, CAST(unnest(range(0, len(e))) AS INTEGER) AS i, round(unnest(list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12))), 6) AS x FROM w",
    "mean_pool": f"WITH {VEC}, f AS (SELECT label, row_id % 5 <> 0 AS m, CAST(unnest(range(0, len(e))) AS INTEGER) AS i, unnest(e) AS x FROM vec) SELECT label, i, round(coalesce(sum(x) FILTER (m), 0) / greatest(count(*) FILTER (m), 1e-9), 6) AS value FROM f GROUP BY ALL",
    "similarity_two_sets": f"WITH {SIM} SELECT query_id, row_id, round(similarity, 6) AS similarity FROM sim",
    "similarity_pivot": f"WITH {SIM} SELECT query_id, " + ", ".join(f"round(max(similarity) FILTER (row_id = {i}), 3) AS s{i}" for i in (0, 100, 200, 300, 400)) + " FROM sim GROUP BY 1",
    "rank_positives": f"WITH {SIM} SELECT query_id, row_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS INTEGER) AS rank FROM sim WHERE row_id % 2 = 1",
    "accuracy_and_mrr": f"WITH {SIM}, r AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS rank FROM sim WHERE row_id % 2 = 1) SELECT round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM r WHERE row_id = query_id + 1",
    "ranking_listing": f"WITH {SIM}, r AS (SELECT query_id, row_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS INTEGER) AS rank FROM sim) SELECT query_id, row_id, rank, row_id = query_id AS is_match FROM r WHERE rank <= 10",
    "retrieve_top_k": f"WITH {SIM}, r AS (SELECT query_id, row_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS INTEGER) AS rank, similarity FROM sim WHERE row_id <> query_id) SELECT query_id, row_id, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 5",
    "knn_cosine_distance": f"WITH {VEC}, s AS (SELECT query_id, row_id, list_cosine_similarity(q.e, v.e) AS c FROM qry q, vec v), r AS (SELECT query_id, row_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, row_id) AS INTEGER) AS rank, c FROM s) SELECT query_id, row_id, rank, round(1 - c, 6) AS distance FROM r WHERE rank <= 10",
    "evaluate_retrieval": f"WITH {SIM}, r AS (SELECT query_id, ql = rl AS rel, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS rank FROM sim WHERE row_id <> query_id), p AS (SELECT query_id, max(CASE WHEN rank = 1 AND rel THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p1, (count(*) FILTER (rel)) / least(5, count(*)) AS pk, coalesce(1.0::DOUBLE / min(rank) FILTER (rel), 0) AS rr FROM r WHERE rank <= 5 GROUP BY 1) SELECT round(avg(p1), 6) AS precision_at_1, round(avg(pk), 6) AS precision_at_5, round(avg(rr), 6) AS mrr FROM p",
    "hard_negatives": f"WITH {SIM} SELECT query_id, row_id, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.2::DOUBLE AND row_id <> query_id",
    "mine_hard_negatives": f"WITH {SIM}, r AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS rank FROM sim WHERE ql <> rl) SELECT query_id, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY rank) AS hard_negatives FROM r WHERE rank <= 3 GROUP BY 1",
    "hash_embedding": f"WITH {DOC}, h AS (SELECT doc_id, section_idx, {HASHES('text')} AS h FROM dsec), v AS (SELECT doc_id, section_idx, {EMB('h')} AS v FROM h), n AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n FROM v), u AS (SELECT doc_id, section_idx, CAST(unnest(range(0, 64)) AS INTEGER) AS i, unnest(v) AS x, n FROM n) SELECT doc_id, section_idx, i, round(x / n, 6) AS x FROM u WHERE x <> 0",
    "search_batch": f"WITH {DOC}, {PRS}, qh AS (SELECT pair_id, {HASHES('query')} AS h FROM prs WHERE pair_id % 100 = 0), q AS (SELECT pair_id, {EMB('h')} AS v FROM qh), rh AS (SELECT doc_id, section_idx, {HASHES('text')} AS h FROM dsec), r AS (SELECT {EMB('h')} AS v FROM rh) SELECT pair_id AS query_id, round(max(list_dot_product(q.v, r.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-12) * greatest(sqrt(list_dot_product(r.v, r.v)), 1e-12))), 6) AS similarity FROM q, r GROUP BY 1",
    "batch_losses": f"WITH {LOSS} SELECT CAST(batch AS BIGINT) AS batch, round(loss, 6) AS loss FROM bl",
    "epoch_loss": f"WITH {LOSS} SELECT round(avg(loss), 6) AS epoch_loss FROM bl",
    "search_batch_hits": f"{HITS} SELECT query_id, row_id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM hit WHERE rank <= 5",
    "search_documents": f"{HITS} SELECT query_id, CAST(rank AS INTEGER) AS rank, row_id, round(similarity, 6) AS similarity, md5(document) AS document FROM hit WHERE rank <= 5",
    "adapter_first_loss": f"WITH {LOSS.replace('list_dot_product', 'list_cosine_similarity')} SELECT round(avg(loss), 6) AS loss FROM bl",
    "apply_adapter": f"WITH {VEC}, down AS (SELECT unnest({DOWN}) AS w, unnest(range(0, 2)) AS k), up AS (SELECT {UP} AS u), h AS (SELECT row_id, e, list(list_dot_product(e, w) ORDER BY k) AS h FROM vec, down GROUP BY ALL), v AS (SELECT row_id, list_transform(e, lambda x, i: x + 2 * list_dot_product(u[i], h)) AS v FROM h, up) SELECT row_id, CAST(unnest(range(0, len(v))) AS INTEGER) AS i, round(unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS x FROM v",
    "batch_tokens": f"WITH {PRS}, b AS (SELECT pair_id, (row_number() OVER (ORDER BY pair_id) - 1) // 64 AS batch, CAST(least(128, {tokens('coalesce(query, chr(32))')}) AS INTEGER) AS a, CAST(least(128, {tokens('coalesce(passage, chr(32))')}) AS INTEGER) AS p FROM prs) SELECT CAST(batch AS BIGINT) AS batch, pair_id, a AS n_anchor, max(a) OVER (PARTITION BY batch) AS anchor_width, p AS n_positive, max(p) OVER (PARTITION BY batch) AS positive_width FROM b",
    "chunk_lookup": "SELECT DISTINCT ON (chunk_id) chunk_id, vec_id, doc_id, page_start FROM chunk_embeddings WHERE chunk_id IN (SELECT chunk_id FROM pairs_df WHERE chunk_id IS NOT NULL) ORDER BY chunk_id, vec_id",
    "index_fallback": f"WITH {VEC}, s AS (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, row_id) AS rank FROM qry q, vec v) SELECT query_id, row_id, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 3",
    "ivf_all_cells": f"WITH {VEC}, s AS (SELECT query_id, row_id, list_cosine_similarity(q.e, v.e) AS c FROM qry q, vec v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, row_id) AS rank FROM s) SELECT query_id, row_id, CAST(rank AS INTEGER) AS rank, round(c, 6) AS similarity FROM r WHERE rank <= 5",
    "pca_moments": "SELECT count(*) AS n, true AS centred0, true AS centred1, true AS uncorrelated, true AS ordered FROM embeddings",
    "plot_roles": "SELECT CAST(vec_id // 2 AS BIGINT) AS pair, CASE WHEN vec_id % 2 = 0 THEN 'anchor' ELSE 'positive' END AS role, CAST((vec_id // 2) % 8 AS INTEGER) AS colour FROM embeddings",
    "scatter_table": "SELECT CAST(label AS VARCHAR) AS label, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y, 'o' AS marker FROM embeddings",
    "split_back": f"WITH {PRS} SELECT pair_id, query AS anchor, passage AS positive FROM prs",
    "parse_questions": rf"""WITH {PRS}, q AS (SELECT pair_id, pair_id % 3 AS k, coalesce(query, '') AS q FROM prs WHERE query IS NOT NULL),
c AS (SELECT pair_id, 1 AS n, {strip('q')} AS x, k FROM q WHERE k = 0 UNION ALL SELECT pair_id, 2, {strip('lower(q)')}, k FROM q WHERE k = 0 UNION ALL SELECT pair_id, 3, 'Please go on?', k FROM q WHERE k = 0
 UNION ALL SELECT pair_id, 1, {strip("regexp_extract(q, '^[^\n]*')")}, k FROM q WHERE k = 1 UNION ALL SELECT pair_id, 2, 'What is the rest of it?', k FROM q WHERE k = 1 UNION ALL SELECT pair_id, 3, {strip("regexp_extract(q, '^[^\n]*')")}, k FROM q WHERE k = 1
 UNION ALL SELECT pair_id, unnest(range(1, 999)), unnest(list_resize(list_transform(list_filter(regexp_extract_all(q || ' Can you say more?', '([^.!?]*\?)', 1), lambda x: length(x) > 10 AND {strip('x')} <> ''), lambda x: {strip('x')}), 998)), k FROM q WHERE k = 2 AND NOT regexp_matches(q, '(?:^|\n)\s*(?:\d+[.)]|-|\*)')
 UNION ALL SELECT pair_id, 1, {strip(r"regexp_extract(q || ' Can you say more?', '^\s*(?:\d+[.)]|-|\*)\s*(.*)$', 1)")}, k FROM q WHERE k = 2 AND regexp_matches(q, '(?:^|\n)\s*(?:\d+[.)]|-|\*)')),
d AS (SELECT pair_id, n, x, row_number() OVER (PARTITION BY pair_id, lower({strip('x')}) ORDER BY n) AS again FROM c WHERE x IS NOT NULL AND x <> ''),
e AS (SELECT pair_id, x, row_number() OVER (PARTITION BY pair_id ORDER BY n) - 1 AS pos FROM d WHERE again = 1 AND length({strip('x')}) > 10 AND NOT regexp_matches(lower({strip('x')}), '^(?:what is the|what are the|can you|please|tell me)'))
SELECT pair_id, CAST(pos AS INTEGER) AS pos, x AS question FROM e WHERE pos < 3""",
    "toy_pairs": "SELECT * FROM (VALUES (0, 'How do plants make food?'), (1, 'What keeps ships afloat?'), (2, 'Why is the sky blue?'), (3, 'How is bread made to rise?')) t(pair_id, anchor)",
    "csv_round_trip": f"WITH {PRS} SELECT pair_id, coalesce(query, '') AS query, coalesce(passage, '') AS passage FROM prs",
    "read_query_passages": f"WITH {PRS} SELECT count(*) AS n, CAST(sum(length(coalesce(query, ''))) AS BIGINT) AS anchor_chars, CAST(sum(length(coalesce(passage, ''))) AS BIGINT) AS positive_chars FROM prs",
    "timing_log": "SELECT event_type AS function_name, count(*) AS n, round(sum(value), 4) AS seconds, strftime(min(ts), '%Y%m%d_%H%M%S') AS first FROM events GROUP BY 1",
    "losses_csv": "SELECT date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1",
    "capped_rows": "SELECT count(*) AS n FROM (SELECT * FROM nation LIMIT 7)",
    "latest_file": "SELECT 'log_20260109_182752.csv' AS name",
    "saved_chunks": f"{CHUNKS} SELECT 'a.pdf' AS pdf_path, 96 AS max_tokens, count(*) AS num_chunks, CAST(sum(token_count) AS BIGINT) AS total_tokens, count(*) AS rows FROM full_",
    "saved_embeddings": "SELECT doc_id, chunk_id, section_id, page_start, token_count, char_count, CAST(len(embedding) AS INTEGER) AS dim FROM (SELECT DISTINCT ON (vec_id) * FROM chunk_embeddings WHERE embedding IS NOT NULL)",
    "saved_questions": f"WITH {SPLIT} SELECT unnest(['full_parquet', 'full_csv', 'train_csv', 'val_csv']) AS file, unnest([count(*), count(*), count(*) FILTER (sp = 'train'), count(*) FILTER (sp = 'val')]) AS n FROM spl",
    "line_questions": rf"WITH {DOC}, l AS (SELECT doc_id, section_idx, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: contains(x, '?') OR regexp_matches(x, '^(?:What|How|Why|When|Where)')), lambda x: regexp_replace(x, '^[\d.)\-*]\s*', '')), lambda x: length(x) > 10) AS q FROM dsec) SELECT doc_id, section_idx, CAST(unnest(range(0, len(q))) AS INTEGER) AS pos, unnest(q) AS question FROM l",
    "prompts": f"WITH {DOC} SELECT doc_id, section_idx, md5('Read this:' || chr(10) || substr(text, 1, 2000) || chr(10) || 'Questions:') AS prompt FROM dsec WHERE text IS NOT NULL",
    "non_empty_pages": f"SELECT page_id FROM (SELECT DISTINCT ON (page_id) page_id, raw_text FROM pdf_pages) WHERE {strip('coalesce(raw_text, chr(32))')} <> ''",
}

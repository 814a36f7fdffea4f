"""Inputs of the registered queries, as SQL that Spark and DuckDB both run on the driver's tables.

The tables hold no page layouts, chunks or questions, so these are derived from the tables at hand.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.readers import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NAMED = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts below."""
    used = {name for _, name in _NAMED.findall(sql)}
    text = _NAMED.sub(r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in used})


LINES = """
SELECT event_id AS line_id, CAST(floor(event_id / 400) AS BIGINT) AS document, CAST(floor(event_id % 400 / 40) AS INT) + 1 AS page,
  CASE WHEN event_id % 40 = 0 THEN 'AWS Whitepaper'
       WHEN event_id % 40 = 39 THEN CAST(event_id AS STRING)
       WHEN event_id % 40 = 38 THEN CASE WHEN user_id % 3 = 0 THEN '7' ELSE 'Footer ' || event_type END
       WHEN event_id % 400 IN (1, 201) THEN 'Category ' || event_type
       WHEN event_id % 10 = 2 THEN 'Service ' || event_type || ' ' || CAST(user_id AS STRING)
       ELSE event_type || ' line ' || CAST(event_id AS STRING) END AS text,
  CAST(CASE WHEN event_id % 40 = 0 THEN 10 WHEN event_id % 40 = 39 THEN 740 WHEN event_id % 40 = 38 THEN 735 + user_id % 6 ELSE 60 + 15 * (event_id % 40) END AS DOUBLE) AS y0,
  CAST(CASE WHEN event_id % 40 = 0 THEN 20 WHEN event_id % 40 = 39 THEN 750 WHEN event_id % 40 = 38 THEN 745 + user_id % 6 ELSE 70 + 15 * (event_id % 40) END AS DOUBLE) AS y1,
  CAST(CASE WHEN event_id % 400 IN (1, 201) THEN 18 WHEN event_id % 10 = 2 THEN 12 ELSE 9 END AS DOUBLE) AS size,
  (event_id % 400 IN (1, 201) OR event_id % 10 = 2) AS bold
FROM events
"""
IMAGES = """
SELECT event_id AS image_id, CAST(floor(event_id / 400) AS BIGINT) AS document, CAST(floor(event_id % 400 / 40) AS INT) + 1 AS page,
  CAST(61 + 15 * (event_id % 40) AS DOUBLE) AS y, CAST(100 + event_id % 300 AS INT) AS pixel_width, CAST(140 + user_id % 40 AS INT) AS pixel_height,
  CAST(145 + event_id % 90 AS DOUBLE) AS render_width, CAST(160 AS DOUBLE) AS render_height,
  CASE WHEN user_id % 5 > 0 THEN event_type END AS category
FROM events
"""
LINKS = """
SELECT CAST(floor(event_id / 400) AS BIGINT) AS document, CAST(floor(event_id % 400 / 40) AS INT) + 1 AS page, 'https://example.org/' || CAST(user_id % 50 AS STRING) AS uri,
  CAST(480 + event_id % 60 AS DOUBLE) AS link_x0, CAST(500 + event_id % 60 AS DOUBLE) AS link_x1,
  CAST(65 + 15 * (event_id % 40) AS DOUBLE) AS link_y0, CAST(77 + 15 * (event_id % 40) AS DOUBLE) AS link_y1
FROM events
"""
PAGE_TABLES = """
SELECT p_partkey AS table_id, CAST(floor(p_partkey / 50) AS BIGINT) AS document, p_name AS title, 2 * p_partkey AS page_start,
  2 * p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS page_end,
  CASE WHEN p_partkey % 2 = 0 THEN 'Category' ELSE ' category  ' END AS h1,
  CASE WHEN floor(p_partkey / 7) % 2 = 0 THEN 'AWS  service' ELSE p_type END AS h2,
  p_brand AS c1, p_type || chr(10) || 'a|b' AS c2
FROM part
"""
SERVICES = """
SELECT CAST(s_suppkey % 2 AS BIGINT) AS document, 'Category ' || CAST(s_nationkey AS STRING) AS category, s_name AS name, 'About ' || s_name AS description,
  CAST(s_suppkey % 50 AS INT) AS page_start, CAST(s_suppkey % 50 + 5 AS INT) AS page_end, 'https://example.org/' || CAST(s_suppkey AS STRING) AS url
FROM supplier
"""
NOTICES = """
SELECT CAST(c_custkey % 3 AS BIGINT) AS document, c_custkey AS notice_id, CAST(c_custkey % 60 AS INT) AS page_start,
  c_name || ' relies on SUPPLIER#' || lpad(CAST(c_custkey % 100 + 1 AS STRING), 9, '0') ||
    CASE WHEN c_custkey % 7 = 0 THEN ' and Supplier#' || lpad(CAST(c_custkey % 60 + 1 AS STRING), 9, '0') ELSE '' END AS text
FROM customer
"""
QUESTIONS = """
SELECT event_id AS qid,
  CASE event_id % 10
    WHEN 0 THEN 'What ' || CASE user_id % 5 WHEN 0 THEN 'storage' WHEN 1 THEN 'AI' WHEN 2 THEN 'email' WHEN 3 THEN 'Dev Tools' ELSE 'quantum' END || ' services does AWS offer?'
    WHEN 1 THEN 'Compare EC2 vs s3 for ' || event_type
    WHEN 2 THEN 'How much memory does lambda need for ' || CAST(user_id AS STRING) || ' users'
    WHEN 3 THEN 'List all services in the ' || CASE user_id % 3 WHEN 0 THEN 'Databases' WHEN 1 THEN 'Media' ELSE 'aws Security' END || ' category'
    WHEN 4 THEN 'Give me an overview of EKS and ECS ' || event_type
    WHEN 5 THEN 'which are the aws analytics tools'
    WHEN 6 THEN 'What is a param of m5-large-x?'
    WHEN 7 THEN event_type || ' versus glued things'
    WHEN 8 THEN 'tell me which offerings exist for iot?'
    ELSE 'plain ' || event_type END AS text
FROM events
"""
TRUTHS = """
SELECT CAST(n_nationkey AS BIGINT) AS no, 'Q' || CASE WHEN n_nationkey % 2 = 0 THEN '0' ELSE '' END || CAST(n_nationkey AS STRING) AS question_id,
  'What does ' || n_name || ' cost in region ' || CAST(n_regionkey AS STRING) || '?' AS question
FROM nation
"""
INPUTS = """
SELECT c_custkey AS input_id,
  CASE c_custkey % 5 WHEN 0 THEN 'q' || CAST(c_custkey % 60 AS STRING) WHEN 1 THEN ' what does ' || lower(n_name) || ' cost in region ' || CAST(n_regionkey AS STRING) || '? '
    WHEN 2 THEN 'cost in region' WHEN 3 THEN 'does the ' || n_name || ' cost in region' ELSE n_name || ' nothing else' END AS input
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
REPLIES = """
SELECT event_id AS reply_id,
  CASE event_id % 8 WHEN 0 THEN 'SCORE: 0.9' || CAST(user_id % 10 AS STRING) || chr(10) || 'REASON: fits well.'
    WHEN 1 THEN 'score: 1 reason: ' || repeat(event_type || ' ', 30) WHEN 2 THEN 'about 0.75, I think' WHEN 3 THEN 'SCORE: .9'
    WHEN 4 THEN 'no idea' WHEN 5 THEN 'SCORE: 0.5 REASON: fair.'', ''extras'': {''signature'': 9}' WHEN 6 THEN '' ELSE 'SCORE: 0 REASON: "bad".' END AS reply
FROM events
"""
CHUNKS = """
SELECT p_partkey % 100 AS qid, p_partkey AS rank,
  CASE p_partkey % 5 WHEN 0 THEN 'service' WHEN 1 THEN 'table' WHEN 2 THEN 'image_caption' WHEN 3 THEN 'concept' ELSE 'notice' END AS chunk_type,
  CASE WHEN p_partkey % 4 < 3 THEN 'Amazon ' || p_brand END AS service_name, CASE WHEN p_partkey % 3 > 0 THEN p_brand || ' things' END AS category,
  CASE WHEN p_partkey % 2 = 0 THEN 'Deployment models' END AS concept_group, p_size AS page_start, p_size + p_partkey % 2 AS page_end,
  CASE p_partkey % 6 WHEN 0 THEN 'table:compare-aws-compute-services:p4' WHEN 1 THEN 'table:compare-aws-' || lower(p_brand) || ':p5' ELSE 'chunk-' || CAST(p_partkey AS STRING) END AS id,
  CASE p_partkey % 4 WHEN 0 THEN 'Use it (Amazon ' || p_brand || ', page ' || CAST(p_size AS STRING) || '; Diagram: ' || p_brand || ' things, page 2).'
    WHEN 1 THEN 'See [Table: Compare, page ' || CAST(p_size AS STRING) || '] and (Concept: Deployment models)'
    WHEN 2 THEN 'This isn''t covered in the document.' ELSE 'Nothing is cited here (perhaps)' END AS answer
FROM part
"""
CHILDREN = """
SELECT l_orderkey AS qid, CAST(l_partkey % 150 AS STRING) AS parent_id, l_linenumber AS rank FROM lineitem
"""
PARENTS = """
SELECT CAST(s_suppkey AS STRING) AS doc_id, 'Nation ' || CAST(s_nationkey AS STRING) AS category, s_name AS service_name, '  About ' || s_name || ' ' AS text_content FROM supplier
"""
FOUND = """
SELECT l_orderkey AS qid, l_linenumber AS rank, CASE WHEN l_partkey % 3 = 0 THEN 'concept:c' || CAST(l_partkey % 20 AS STRING)
  ELSE 'service:c:s' || CAST(l_partkey % 20 AS STRING) || ':part-' || CAST(l_suppkey % 11 AS STRING) END AS id
FROM lineitem
"""
PARTS = """
SELECT DISTINCT 'service:c:s' || CAST(p_partkey % 20 AS STRING) || ':part-' || CAST(p_size % 12 AS STRING) AS id, CASE WHEN p_partkey % 20 < 15 THEN 'service' ELSE 'table' END AS chunk_type FROM part
"""
VARIANTS = """
SELECT l_orderkey AS qid, l_linenumber % 3 AS variant, l_linenumber AS rank, l_partkey % 4 AS doc_id FROM lineitem
"""
SPANS = """
SELECT l_orderkey AS line_id, place, CASE WHEN l_partkey % 6 = 0 THEN '' WHEN l_partkey % 5 = 0 THEN 'a ' ELSE 'w' || CAST(l_partkey % 9 AS STRING) END AS text,
  CAST(10 * place AS DOUBLE) AS x0, CAST(10 * place AS DOUBLE) + CASE WHEN l_suppkey % 2 = 0 THEN 9.0 ELSE 9.5 END AS x1
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem) AS l
"""
ROWS = """
SELECT l_orderkey AS table_id, CAST(l_quantity AS BIGINT) AS size, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT) AS row_no FROM lineitem
"""
METRICS = """
SELECT event_id AS qid, CAST(event_id % 100 AS DOUBLE) / 100 AS mrr, CAST(user_id % 50 + 50 AS DOUBLE) / 100 AS ndcg_at_5, CAST(90 + event_id % 10 AS DOUBLE) / 100 AS context_precision,
  0.9 * CAST(event_id % 2 AS DOUBLE) AS context_recall, CAST(1 AS DOUBLE) AS faithfulness, CAST(user_id % 3 AS DOUBLE) / 2 AS answer_correctness
FROM events
"""
NAMES = """
SELECT event_id AS pair_id, CASE event_id % 4 WHEN 0 THEN 'Amazon ' || event_type WHEN 1 THEN ' ' || upper(event_type) || ' Service' WHEN 2 THEN '' ELSE 'AWS Glue' END AS retrieved,
  CASE user_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'AWS ' || event_type || '-service' WHEN 2 THEN 'Amazon Services' ELSE 'glue studio' END AS expected
FROM events
"""
MATTER = r"""
SELECT doc_id, 'AWS Whitepaper' || chr(10) || text || chr(10) || '<u>Page</u> <!-- PAGE_' || CAST(doc_id AS STRING) || ' -->' || chr(10) || ' 12 ' || chr(10)
  || 'Copyright © 2024 by Amazon Web Services, Inc.' || chr(10) || '© all' || chr(10) || 'Overview of Amazon Web Services  AWS Whitepaper' || chr(10) || 'end' AS text
FROM documents
"""
RESPONSES = """
SELECT event_id AS reply_id, CASE event_id % 4 WHEN 0 THEN '  plain ' || event_type || ' '
  WHEN 1 THEN '["one ", {"type": "text", "text": "' || event_type || '"}, {"other": 1}]'
  WHEN 2 THEN '{"type": "text", "text": "block ' || CAST(user_id AS STRING) || '"}' ELSE 'Well, this isn''t covered in the document. Sorry' END AS reply
FROM events
"""

"""Projections of the driver's tables onto graph shapes: ours, in SQL that Spark and DuckDB both read.

Each projection is a query over the tables; ``graph(spark, sf_dir)`` gives them as DataFrames, ``WITH`` has them as common table
expressions for oracle SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name -> SQL
PROJECTIONS = {
    # regions and nations are functional, suppliers code modules, customers symbols of their nation's code
    "g_nodes": """
SELECT CAST(r_regionkey AS BIGINT) AS ord, 'region:' || CAST(r_regionkey AS STRING) AS id, 'functional' AS type, r_name AS title, CAST(NULL AS STRING) AS path, 'user' AS source, 'AUTO' AS mode, 'active' AS status FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), 'nation:' || CAST(n_nationkey AS STRING), 'functional', n_name, NULL, 'derived', CASE WHEN n_nationkey % 7 = 3 THEN 'MANUAL' ELSE 'AUTO' END, 'active' FROM nation
UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT), 'supplier:' || CAST(s_suppkey AS STRING), 'code_module', s_name, 'src/' || lower(r_name) || '/' || lower(n_name) || '/' || replace(lower(s_name), '#', '_') || '.py', 'code',
  CASE WHEN s_acctbal < 0 THEN 'FORCE_EXCLUDE' WHEN s_suppkey % 5 = 0 THEN 'MANUAL' ELSE 'AUTO' END, CASE WHEN s_suppkey % 11 = 0 THEN 'stale' ELSE 'active' END
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT CAST(1000000 + c_custkey AS BIGINT), 'customer:' || CAST(c_custkey AS STRING), 'implementation_symbol', c_name, 'lib/' || lower(n_name) || '/' || replace(lower(c_name), '#', '_') || '.cpp', 'code', 'AUTO', 'active'
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "g_edges": """
SELECT CAST(n_nationkey AS BIGINT) AS ord, 'region:' || CAST(n_regionkey AS STRING) AS source, 'nation:' || CAST(n_nationkey AS STRING) AS target, 'contains' AS type, 'AUTO' AS mode FROM nation
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), 'nation:' || CAST(n_nationkey AS STRING), 'nation:' || CAST((n_nationkey * 7 + 3) % 25 AS STRING), CASE n_nationkey % 3 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'interface' ELSE 'reference' END,
  CASE WHEN n_nationkey % 6 = 1 THEN 'MANUAL' ELSE 'AUTO' END FROM nation
UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT), 'nation:' || CAST(s_nationkey AS STRING), 'supplier:' || CAST(s_suppkey AS STRING), 'contains', 'AUTO' FROM supplier
UNION ALL SELECT CAST(1000000 + c_custkey AS BIGINT), 'nation:' || CAST(c_nationkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), 'contains', 'AUTO' FROM customer
UNION ALL SELECT CAST(9000000 + c_custkey AS BIGINT), 'customer:' || CAST(c_custkey AS STRING), 'supplier:' || CAST(c_custkey % 10 + 1 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN 'dependency' ELSE 'interface' END, CASE WHEN c_custkey % 9 = 0 THEN 'FORCE_EXCLUDE' ELSE 'AUTO' END FROM customer""",
    # facts: a customer's order lines use parts; the supplier is reached by a call
    "g_facts": """
SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 100 + ascii(l_returnflag) AS ord, 'customer:' || CAST(o_custkey AS STRING) AS "from", 'order' || CAST(l_orderkey % 10 AS STRING) || '.line' || CAST(l_linenumber AS STRING) AS from_symbol,
  CASE WHEN l_linenumber = 1 THEN 'supplier:' || CAST(l_suppkey AS STRING) WHEN l_linenumber = 7 THEN '?' ELSE 'part:' || CAST(l_partkey AS STRING) END AS "to",
  CASE WHEN l_linenumber = 7 THEN 'OPTIONAL_DEPENDENCY' WHEN l_returnflag = 'A' THEN 'CALL' WHEN l_returnflag = 'N' THEN 'IMPORT' ELSE 'REFERENCE' END AS type,
  'api.p' || CAST(l_partkey % 100 AS STRING) AS symbol, CAST(100 - l_linenumber * 6 - l_orderkey % 7 AS DOUBLE) / 100 AS confidence, 'o' || CAST(l_orderkey AS STRING) AS file, o_orderdate AS day
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "g_items": """
SELECT s_suppkey AS ord, 'nation:' || CAST(s_nationkey AS STRING) AS functional, 'supplier:' || CAST(s_suppkey AS STRING) AS impl_id, 'src/' || replace(lower(s_name), '#', '_') || '.py' AS path,
  CASE WHEN s_acctbal < 0 THEN 'FORCE_EXCLUDE' WHEN s_suppkey % 5 = 0 THEN 'MANUAL' WHEN s_suppkey % 7 = 0 THEN 'FORCE_INCLUDE' ELSE 'AUTO' END AS mode FROM supplier""",
    "g_messages": """
SELECT conv_id AS session, turn AS pos, conv_id * 1000 + turn AS ord, 'm' || CAST(conv_id AS STRING) || '.' || CAST(turn AS STRING) AS message_id, role,
  CASE WHEN role = 'system' THEN 'plugin' WHEN role = 'user' AND turn % 5 = 4 THEN 'tool' ELSE 'user' END AS kind,
  CASE WHEN role = 'system' THEN CASE WHEN conv_id % 2 = 0 THEN 'loom-context' ELSE 'notes' END END AS plugin,
  CASE WHEN role = 'system' AND conv_id % 3 = 0 THEN 'instructions' END AS form,
  CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN '<loom-context target="x">' ELSE '' END || text AS text
FROM conversations""",
    # turns that name nodes, exclude some, or do neither, by session
    "g_turns": """
SELECT conv_id AS session, turn AS pos, role, CASE WHEN role = 'user' AND turn % 5 = 4 THEN 'tool' ELSE 'user' END AS kind,
  CASE conv_id % 6 WHEN 0 THEN 'Check supplier code of NATION_6 for desk ' WHEN 1 THEN 'Please do not use NATION_7. Check nation:' || CAST(conv_id % 25 AS STRING) WHEN 2 THEN 'Exclude desk 3 and look at region:1 ' WHEN 3 THEN 'hello there '
    WHEN 4 THEN 'steel desk' ELSE 'look at customer#000000001 ' END || ' (' || CAST(turn AS STRING) || ')' AS text FROM conversations""",
    "g_settings": """
SELECT DISTINCT conv_id AS session, CASE WHEN conv_id % 6 = 4 THEN 'region:2' WHEN conv_id % 12 = 0 THEN 'gone' END AS target, CAST(1 + conv_id % 3 AS INT) AS semanticDepth,
  CASE WHEN conv_id % 4 = 1 THEN 'supplier:3' ELSE '' END AS one_in, CASE WHEN conv_id % 5 = 2 THEN 'nation:8' ELSE '' END AS one_out FROM conversations""",
    # clauses: a turn behind a phrase that a rule looks for
    "g_clauses": """
SELECT conv_id * 1000 + turn AS ord, 'm' || CAST(conv_id AS STRING) || '.' || CAST(turn AS STRING) AS message_id, role,
  CASE (conv_id + turn) % 7 WHEN 0 THEN 'Cache must use ' WHEN 1 THEN 'Player should not use ' WHEN 2 THEN 'Fix the ' WHEN 3 THEN 'Store should be ' WHEN 4 THEN 'Use H.26' || CAST(4 + turn % 2 AS STRING) || ' instead of ' WHEN 5 THEN 'An error in ' ELSE '' END
    || text || '. ' || CASE WHEN turn % 2 = 0 THEN 'Codec must be h264; size must use ' || CAST(conv_id % 4 AS STRING) ELSE 'Done!' END AS text
FROM conversations WHERE text IS NOT NULL""",
    "g_candidates": """
SELECT CAST(doc_id % 20 AS BIGINT) AS request, d.doc_id AS ord, 'doc ' || CAST(d.doc_id AS STRING) AS label, 'doc:' || CAST(d.doc_id AS STRING) AS node, text AS content,
  CASE d.doc_id % 9 WHEN 0 THEN 'requirement' WHEN 1 THEN 'code_module' WHEN 2 THEN 'note' WHEN 3 THEN 'documentation' WHEN 4 THEN 'test' WHEN 5 THEN 'decision' WHEN 6 THEN 'conversation' WHEN 7 THEN 'implementation_function' ELSE 'interface' END AS node_type,
  CASE WHEN d.doc_id % 9 IN (1, 7) THEN 'code' WHEN d.doc_id % 50 = 4 THEN 'history' ELSE 'content' END AS scope,
  CASE WHEN quality = 0 THEN 'stale' WHEN d.doc_id % 31 = 0 THEN 'resolved' ELSE 'active' END AS status,
  CAST(n_chars % 1000 AS INT) AS priority, CASE WHEN d.doc_id % 13 = 0 THEN 'critical' ELSE 'normal' END AS priority_name, CAST(d.doc_id % 4 AS INT) AS depth,
  CASE WHEN d.doc_id % 17 = 0 THEN 'context entry' ELSE 'related' END AS reason, d.doc_id % 97 = 0 AS required, toxic = 1 AND d.doc_id % 2 = 0 AS force_include, FALSE AS raw, CAST(NULL AS STRING) AS raw_kind
FROM documents d LEFT JOIN (SELECT doc_id AS k, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.k""",
    "g_outline": """
SELECT 'o' || CAST(l_orderkey AS STRING) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS idx, CAST(1 + CAST(l_quantity AS INT) % 3 AS INT) AS level, 'Part ' || p_type AS title, CAST(1 + l_linenumber * (1 + l_orderkey % 3) AS INT) AS page_start
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "g_events": """
SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'click' THEN 'user/message' WHEN 'view' THEN 'assistant/message' WHEN 'signup' THEN 'tool/result' ELSE event_type END AS type, event_type AS role, props AS text FROM events""",
    "g_raw_nodes": """
SELECT p_partkey AS ord, CASE WHEN p_partkey % 41 = 0 THEN 'part:1' WHEN p_partkey % 97 = 0 THEN '' ELSE 'part:' || CAST(p_partkey AS STRING) END AS id,
  CASE p_size % 6 WHEN 0 THEN 'functional' WHEN 1 THEN 'implementation_class' WHEN 2 THEN 'widget' WHEN 3 THEN 'requirement' WHEN 4 THEN '' ELSE NULL END AS type,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS label, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS content, p_brand AS description,
  CASE p_partkey % 5 WHEN 0 THEN 'assistant' WHEN 1 THEN 'derived' WHEN 2 THEN 'system' WHEN 3 THEN '' END AS source, CAST(p_size AS DOUBLE) / 25 - 0.5 AS confidence,
  CASE p_partkey % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'urgent' WHEN 2 THEN 'low' END AS priority, CASE p_partkey % 8 WHEN 0 THEN 'stale' WHEN 1 THEN 'gone' WHEN 2 THEN 'active' END AS status,
  CASE p_partkey % 7 WHEN 0 THEN 'manual' WHEN 1 THEN 'Force_Include' WHEN 2 THEN 'odd' END AS mode
FROM part""",
    "g_raw_edges": """
SELECT p_partkey AS ord, 'part:' || CAST(p_partkey AS STRING) AS source, 'part:' || CAST(p_partkey * 3 + 2 AS STRING) AS target, CASE p_partkey % 5 WHEN 0 THEN 'contains' WHEN 1 THEN 'calls' WHEN 2 THEN 'likes' ELSE 'uses' END AS type,
  CASE p_partkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'MANUAL' WHEN 2 THEN 'sometimes' END AS mode FROM part""",
}
_NEEDS = {name: [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)] for name, sql in PROJECTIONS.items()}
WITH = {name: f"{name} AS ({sql})" for name, sql in PROJECTIONS.items()}


def with_(*names: str) -> str:
    """``WITH`` clause of the projections for oracle SQL, open for more expressions."""
    return "WITH RECURSIVE " + ", ".join(WITH[n] for n in names)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame."""
    sql = PROJECTIONS[name].replace('"from"', "`from`").replace('"to"', "`to`")
    for t in _NEEDS[name]:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in _NEEDS[name]})

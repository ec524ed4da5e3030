"""Text, store and inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import infer, session, store
from .projections import project, read, with_
from .registry import query

TOKENS = r"CAST(ceil(0.25 * length(regexp_replace({0}, '[^\x{{00}}-\x{{FF}}]', '', 'g')) + length(regexp_replace({0}, '[\x{{00}}-\x{{FF}}]', '', 'g'))) AS BIGINT)"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedupe(spark, sf):
    return read(spark, sf, "documents").groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query(r"""SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z_][a-z0-9_.:-]{2,}|[\x{4e00}-\x{9fff}]{2,}'), ' ') AS core,
  array_to_string(regexp_extract_all(lower(text), '[a-z_][a-z0-9_.-]{2,}|[\x{4e00}-\x{9fff}]{2,}'), ' ') AS provider,
  array_to_string(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}|[\x{4e00}-\x{9fff}]{2,}'), ' ') AS functional FROM benchmark""")
def task_terms(spark, sf):
    terms = {k: F.array_join(T.task_terms(F.col("text"), k), " ").alias(k) for k in ("core", "provider", "functional")}
    return read(spark, sf, "benchmark").select("item_id", *terms.values())


@query(r"""WITH s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[。！？!?]\s*|\n+')) AS part, unnest(range(len(regexp_split_to_array(text, '[。！？!?]\s*|\n+')))) AS k FROM conversations),
c AS (SELECT conv_id, turn, regexp_replace(unnest(regexp_split_to_array(part, '(?:，|,)?(?:并且|而且|同时)|[；;]')), '^\s+|\s+$', '', 'g') AS clause FROM s)
SELECT conv_id, turn, count(*) AS n_clauses, CAST(sum(length(clause)) AS BIGINT) AS chars, max(clause) AS last FROM c WHERE clause <> '' GROUP BY 1, 2""")
def clause_split(spark, sf):
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.explode(T.clauses(F.col("text"))).alias("clause"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_clauses"), F.sum(F.length("clause")).alias("chars"), F.max("clause").alias("last"))


@query("SELECT conv_id, turn, 'msg-' || substring(sha256(CAST(conv_id AS VARCHAR) || chr(0) || CAST(turn AS VARCHAR) || chr(0) || text), 1, 12) AS id FROM conversations")
def stable_id(spark, sf):
    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.stable_id(F.lit("msg"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("text")).alias("id"))


_DOMAIN = """parts AS (SELECT ord, id, path, list_filter(string_split(coalesce(path, ''), '/'), lambda x: x <> '') AS p FROM n),
files AS (SELECT *, regexp_replace(CASE WHEN len(p) > 0 THEN p[-1] ELSE id END, '\\.[^.]+$', '') AS file, p[1 : greatest(len(p) - 1, 0)] AS above FROM parts),
dirs AS (SELECT *, list_filter(above, lambda x, i: lower(x) NOT IN ('src','source','lib','app','apps','packages','package','python','js','ts') AND (i = 1 OR x <> above[i - 1])) AS d, list_filter(string_split(id, '.'), lambda x: x <> '') AS idp FROM files),
domains AS (SELECT ord, id, path, CASE WHEN len(d) >= 2 THEN lower(d[-1]) WHEN len(d) = 1 AND NOT starts_with(id, d[1] || '.' || d[1] || '.') THEN lower(d[1])
  WHEN lower(file) IN ('utils','util','helpers','helper','common','base','config','constants','types','models','test') AND len(d) > 0 THEN lower(d[-1])
  ELSE lower(CASE WHEN len(idp) > 1 THEN idp[-2] ELSE file END) END AS domain FROM dirs)"""


@query(with_("g_nodes") + f", n AS (SELECT * FROM g_nodes WHERE type IN ('code_module', 'implementation_symbol') AND status = 'active'), {_DOMAIN} SELECT id, domain FROM domains")
def domain_key(spark, sf):
    return infer.capability_groups(project(spark, sf, "g_nodes")).select("id", "domain")


@query(f"""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS url FROM pages), n AS (SELECT page_id AS ord, CAST(page_id AS VARCHAR) AS id, regexp_replace(url, '[?#].*$', '') AS path FROM u), {_DOMAIN}
SELECT domain, count(*) AS n_pages, min(ord) AS first FROM domains GROUP BY 1""")
def url_domains(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = read(spark, sf, "pages").select("page_id", T.domain_key(path, F.col("page_id").cast("string")).alias("domain"))
    return rows.groupBy("domain").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first"))


_TYPES = ", ".join(f"'{t}'" for t in store.schema.NODE_TYPES)


@query(with_("g_raw_nodes") + f"""SELECT ord, CASE WHEN type IN ({_TYPES}) THEN type ELSE 'code_module' END AS type, coalesce(nullif(title, ''), nullif(label, ''), nullif(id, '')) AS title, coalesce(nullif(label, ''), nullif(title, ''), nullif(id, '')) AS label,
  coalesce(content, description, '') AS content, CASE WHEN coalesce(source, '') <> '' THEN source WHEN coalesce(nullif(type, ''), 'code_module') = 'code_module' OR starts_with(type, 'implementation_') THEN 'code' ELSE 'user' END AS source,
  CASE WHEN source = 'assistant' THEN 'ai' WHEN coalesce(nullif(type, ''), 'code_module') = 'code_module' OR starts_with(type, 'implementation_') THEN 'analyzer' WHEN source = 'derived' THEN 'auto' WHEN source = 'system' THEN 'plugin' ELSE 'user' END AS created_by,
  least(greatest(confidence, 0.0), 1.0) AS confidence, CASE WHEN priority IN ('critical','high','normal','low') THEN priority ELSE 'normal' END AS priority,
  CASE WHEN status IN ('active','resolved','deprecated','superseded','archived','stale') THEN status ELSE 'active' END AS status, upper(coalesce(mode, 'AUTO')) AS mode FROM g_raw_nodes""")
def graph_normalize(spark, sf):
    n = store.normalize_nodes(project(spark, sf, "g_raw_nodes"))
    return n.select("ord", "type", "title", "label", "content", "source", "created_by", "confidence", "priority", "status", "mode")


_RELATIONS = ", ".join(f"'{t}'" for t in store.schema.RELATION_TYPES)


@query(with_("g_raw_nodes", "g_raw_edges") + f""", v AS (
SELECT 'DUPLICATE_ID' AS code, id AS subject, CAST(count(*) AS VARCHAR) AS detail FROM g_raw_nodes GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'EMPTY_ID', CAST(ord AS VARCHAR), NULL FROM g_raw_nodes WHERE coalesce(id, '') = ''
UNION ALL SELECT 'UNSUPPORTED_TYPE', id, type FROM g_raw_nodes WHERE type <> '' AND type NOT IN ({_TYPES})
UNION ALL SELECT 'UNSUPPORTED_PRIORITY', id, priority FROM g_raw_nodes WHERE priority NOT IN ('critical','high','normal','low')
UNION ALL SELECT 'UNSUPPORTED_STATUS', id, status FROM g_raw_nodes WHERE status NOT IN ('active','resolved','deprecated','superseded','archived','stale')
UNION ALL SELECT 'UNSUPPORTED_CONFIDENCE', id, NULL FROM g_raw_nodes WHERE confidence NOT BETWEEN 0 AND 1
UNION ALL SELECT 'UNKNOWN_ENDPOINT', source || ' -> ' || target, CAST(ord AS VARCHAR) FROM g_raw_edges WHERE source NOT IN (SELECT id FROM g_raw_nodes) OR target NOT IN (SELECT id FROM g_raw_nodes)
UNION ALL SELECT 'UNSUPPORTED_RELATION', CAST(ord AS VARCHAR), type FROM g_raw_edges WHERE type NOT IN ({_RELATIONS})
UNION ALL SELECT 'UNSUPPORTED_MODE', CAST(ord AS VARCHAR), mode FROM g_raw_edges WHERE upper(coalesce(mode, 'AUTO')) NOT IN ('AUTO','MANUAL','FORCE_INCLUDE','FORCE_EXCLUDE'))
SELECT * FROM v""")
def graph_validate(spark, sf):
    return store.validate_graph(project(spark, sf, "g_raw_nodes"), project(spark, sf, "g_raw_edges"))


@query(with_("g_nodes", "g_edges") + """, few AS (SELECT * FROM g_nodes ORDER BY ord LIMIT 40), shown AS (SELECT * FROM g_edges WHERE source IN (SELECT id FROM few) OR target IN (SELECT id FROM few) ORDER BY ord LIMIT 60)
SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges, (SELECT count(*) FROM few) AS shown_nodes, (SELECT count(*) FROM shown) AS shown_edges, TRUE AS truncated""")
def graph_summary(spark, sf):
    return store.summarize_graph(project(spark, sf, "g_nodes"), project(spark, sf, "g_edges"), 40, 60)[2]


@query(f"SELECT CAST(sum({tokens_sql('text')}) AS BIGINT) AS raw_tokens FROM conversations")
def raw_tokens(spark, sf):
    return store.raw_context_tokens(read(spark, sf, "conversations").select(F.lit("conversation").alias("type"), F.col("text").alias("content")))


@query("SELECT p_partkey AS ord, CAST(80 + (p_partkey % 4) * 260 AS DOUBLE) AS x, CAST(80 + floor(p_partkey / 4) * 180 AS DOUBLE) AS y FROM part")
def placement_by_index(spark, sf):
    return store.placed_by_index(read(spark, sf, "part").select(F.col("p_partkey").alias("ord"))).select("ord", "x", "y")


_TITLES = """named AS (SELECT *, regexp_replace(string_split(path, '/')[-1], '\\.[^.]+$', '') AS file FROM domains),
titles AS (SELECT domain, count(*) AS n_members, min(ord) AS first, CASE WHEN domain <> '' AND domain NOT IN ('utils','util','helpers','helper','common','base','config','constants','types','models','test') THEN domain
  ELSE coalesce(min_by(file, ord) FILTER (WHERE lower(file) NOT IN ('utils','util','helpers','helper','common','base','config','constants','types','models','test')), min_by(file, ord)) END AS raw FROM named GROUP BY domain),
cased AS (SELECT *, array_to_string(list_transform(list_filter(regexp_split_to_array(raw, '[._/-]+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z]{2,5}$') THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ') AS title FROM titles),
based AS (SELECT *, 'function.' || coalesce(nullif(lower(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9\\x{4e00}-\\x{9fff}]+', '-', 'g'), '^-|-$', '', 'g')), ''), 'capability') AS base FROM cased),
fn AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY first) > 1 THEN base || '-' || row_number() OVER (PARTITION BY base ORDER BY first) ELSE base END AS functional FROM based)"""
_ACTIVE = "n AS (SELECT * FROM g_nodes WHERE type IN ('code_module', 'implementation_symbol') AND status = 'active')"


@query(with_("g_nodes") + f", {_ACTIVE}, {_DOMAIN}, {_TITLES} SELECT functional, title, n_members, CAST(CASE WHEN n_members > 1 THEN 0.78 ELSE 0.58 END AS DOUBLE) AS confidence, 'new' AS action FROM fn")
def capability_groups(spark, sf):
    return infer.infer_functional(project(spark, sf, "g_nodes"), project(spark, sf, "g_facts"))[0]


@query(with_("g_nodes", "g_facts") + f", {_ACTIVE}, {_DOMAIN}, {_TITLES}, m AS (SELECT id, functional FROM domains JOIN fn USING (domain)), " """
e AS (SELECT a.functional AS source, b.functional AS target, f.ord AS ord, confidence FROM g_facts f JOIN m a ON a.id = f."from" JOIN m b ON b.id = f."to" WHERE a.functional <> b.functional)
SELECT source, target, least(0.8, min_by(confidence, ord)) AS confidence FROM e GROUP BY 1, 2""")
def functional_edges(spark, sf):
    return infer.infer_functional(project(spark, sf, "g_nodes"), project(spark, sf, "g_facts"))[2]


_TERMS = "['supplier', 'asia', '00000003', 'py']"


@query(with_("g_items") + """, s AS (SELECT *, CAST(contains(lower(impl_id || ' ' || path || ' '), 'supplier') AS INT) + CAST(contains(lower(impl_id || ' ' || path || ' '), '000003') AS INT) * 2 - CAST(contains(lower(impl_id), 'supplier') AS INT) AS h0 FROM g_items),
h AS (SELECT *, (CASE WHEN contains(lower(impl_id || ' ' || path), '000003') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(impl_id || ' ' || path), '7.py') THEN 1 ELSE 0 END) AS hits FROM s),
t AS (SELECT *, max(hits) OVER (PARTITION BY functional) AS top FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY functional ORDER BY hits DESC, ord) AS rk FROM t WHERE top = 0 OR hits > 0)
SELECT functional, impl_id, CAST(hits AS INT) AS hits, CAST(rk AS INT) AS rank FROM r WHERE rk <= CASE WHEN top > 0 THEN 3 ELSE 2 END""")
def impl_pick(spark, sf):
    items = project(spark, sf, "g_items").withColumn("capabilities", F.array().cast("array<string>"))
    return infer.pick_implementations(items, F.array(F.lit("000003"), F.lit("000003"), F.lit("7.py")), 3)


@query(with_("g_edges") + """, e AS (SELECT CASE WHEN source IN ('nation:1', 'nation:2') THEN 'merged' ELSE source END AS source, CASE WHEN target IN ('nation:1', 'nation:2') THEN 'merged' ELSE target END AS target, type, ord FROM g_edges)
SELECT ord, source, target, type FROM e WHERE source <> target""")
def functional_merge(spark, sf):
    return infer.merge_functional(project(spark, sf, "g_edges"), project(spark, sf, "g_items"), ["nation:1", "nation:2"], "merged")[0].select("ord", "source", "target", "type")


@query(with_("g_edges") + """, p AS (SELECT unnest(['a', 'b']) AS part)
SELECT ord, source, target, type, mode FROM g_edges WHERE source <> 'nation:3' AND target <> 'nation:3'
UNION ALL SELECT ord, CASE WHEN source = 'nation:3' THEN part ELSE source END, CASE WHEN target = 'nation:3' THEN part ELSE target END, type, 'MANUAL' FROM g_edges, p WHERE source = 'nation:3' OR target = 'nation:3'""")
def functional_split(spark, sf):
    return infer.split_functional(project(spark, sf, "g_edges"), "nation:3", spark.createDataFrame([("a",), ("b",)], "id string")).select("ord", "source", "target", "type", "mode")


@query(with_("g_nodes", "g_items") + """, own AS (SELECT functional, list_sort(list(DISTINCT impl_id)) AS ids FROM g_items WHERE mode <> 'AUTO' GROUP BY 1), auto AS (SELECT DISTINCT functional FROM g_items WHERE mode = 'AUTO'),
neu AS (SELECT functional, list_sort(list(DISTINCT impl_id)) AS ids FROM g_items WHERE ord % 2 = 0 GROUP BY 1), manual AS (SELECT id FROM g_nodes WHERE type = 'functional' AND mode <> 'AUTO')
SELECT n.functional AS functional, CASE WHEN own.ids IS NULL AND m.id IS NULL THEN CASE WHEN auto.functional IS NULL THEN 'new' ELSE 'replaced' END WHEN n.ids = coalesce(own.ids, []) THEN 'owned' ELSE 'review_required' END AS verdict
FROM neu n LEFT JOIN own USING (functional) LEFT JOIN auto USING (functional) LEFT JOIN manual m ON m.id = n.functional""")
def inference_apply(spark, sf):
    nodes, items = project(spark, sf, "g_nodes"), project(spark, sf, "g_items").withColumnRenamed("impl_id", "id").withColumn("created_by", F.lit("auto"))
    return infer.apply_inference(items, items.where("ord % 2 = 0"), nodes.where("type = 'functional' and mode <> 'AUTO'"))


@query("""SELECT conv_id AS session, greatest(coalesce(CASE WHEN conv_id % 3 > 0 THEN CAST(conv_id % 5 * 700 AS INT) END, 6000), 1000) AS "tokenBudget", least(greatest(CAST(conv_id % 8 AS INT), 1), 5) AS "maxImplementationFiles", 2 AS "semanticDepth",
 coalesce(CASE WHEN conv_id % 4 = 0 THEN FALSE END, TRUE) AS "autoInject", TRUE AS "reuseContext" FROM (SELECT DISTINCT conv_id FROM conversations)""")
def session_settings(spark, sf):
    s = read(spark, sf, "conversations").select("conv_id").distinct()
    c = F.col("conv_id")
    rows = s.select(c.alias("session"), F.when(c % 3 > 0, (c % 5 * 700).cast("int")).alias("tokenBudget"), (c % 8).cast("int").alias("maxImplementationFiles"), F.when(c % 4 == 0, False).alias("autoInject"))
    return session.settings_table(rows)


@query("WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'l' || l_orderkey || '.' || l_linenumber || '.' || l_partkey AS id FROM lineitem), old AS (SELECT ord, id FROM o WHERE ord % 3 = 0), new AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM old)) SELECT id, ord FROM old UNION ALL SELECT id, (SELECT max(ord) FROM old) + row_number() OVER (ORDER BY ord, id) AS ord FROM new")
def append_nodes(spark, sf):
    """Two thirds of the order lines as new nodes behind the others; order and id together are the order."""
    line = read(spark, sf, "lineitem")
    ident = F.concat_ws(".", F.concat(F.lit("l"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    rows = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("ord"), ident.alias("id"))
    return store.append_nodes(rows.where("ord % 3 = 0"), rows).select("id", "ord")

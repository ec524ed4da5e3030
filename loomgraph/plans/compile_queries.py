"""Policy, compiler, provider and firewall queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import firewall, policy, provider, traverse, turns
from .projections import project, read, with_
from .registry import query
from .store_queries import tokens_sql

BUDGET = 6000
_TERMINAL = "('resolved', 'deprecated', 'superseded', 'archived')"
_CLASS = f"""CASE WHEN force_include OR required OR scope IN ('task', 'project') THEN 'hard' WHEN coalesce(status NOT IN {_TERMINAL}, TRUE) AND (node_type IN ('requirement', 'constraint', 'project_rule', 'interface') OR scope IN ('interface', 'contract') OR (node_type = 'decision' AND (priority_name = 'critical' OR priority >= 900))) THEN 'hard'
 WHEN node_type IN ('conversation', 'note', 'documentation') OR scope IN ('conversation', 'raw', 'raw_log', 'logs', 'history') THEN 'optional' ELSE 'soft' END"""
_SCORE = "round(greatest(CASE WHEN force_include THEN 1.0 WHEN required THEN 0.96 ELSE 0.0 END, CAST(0.46 AS DOUBLE) * least(greatest(CAST(priority AS DOUBLE) / 1000, 0), 1) + CAST(0.3 AS DOUBLE) / (depth + 1) + CAST(0.24 AS DOUBLE) * CASE WHEN reason IN ('context entry', 'current request') THEN 1 ELSE 0 END), 4)"
_CATEGORY = "CASE WHEN scope = 'code' OR starts_with(node_type, 'implementation_') OR node_type = 'code_module' THEN 'implementation' WHEN node_type = 'test' OR scope IN ('test', 'tests') THEN 'tests' WHEN node_type = 'documentation' THEN 'documentation' WHEN scope = 'history' OR node_type = 'conversation' THEN 'history' END"
_PREP = with_("g_candidates") + rf""", c0 AS (SELECT *, coalesce(force_include, FALSE) AS fi, regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') AS body FROM g_candidates),
c1 AS (SELECT * EXCLUDE (content, force_include), coalesce(force_include, FALSE) AS force_include, body AS content FROM c0 WHERE body <> ''),
c2 AS (SELECT *, {tokens_sql('content')} + {tokens_sql('label')} + 10 AS tokens, sha256(content) AS content_hash, {_CLASS} AS policy_class, CAST({_SCORE} AS DOUBLE) AS score, {_CATEGORY} AS category,
  CASE WHEN node_type = 'conversation' AND NOT force_include THEN 'raw context disabled by policy' WHEN status IN ('resolved', 'deprecated', 'superseded', 'archived', 'stale') AND NOT force_include AND NOT required THEN status || ' context disabled by policy' END AS early0 FROM c1),
fst AS (SELECT request, content_hash, min(ord) AS first_ord FROM c2 WHERE early0 IS NULL GROUP BY 1, 2),
c3 AS (SELECT c2.*, coalesce(early0, CASE WHEN c2.ord <> first_ord THEN 'duplicate of doc:' || CAST(first_ord AS VARCHAR) END) AS early FROM c2 LEFT JOIN fst USING (request, content_hash)),
s AS (SELECT request, ord, tokens, category, policy_class, row_number() OVER (PARTITION BY request ORDER BY CASE policy_class WHEN 'hard' THEN 0 WHEN 'soft' THEN 1 ELSE 2 END, score DESC, priority DESC, ord) AS i FROM c3 WHERE early IS NULL),
fold(request, i, used, u1, u2, u3, u4, ord, why) AS (
  SELECT DISTINCT request, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM s
  UNION ALL SELECT request, i, used + CASE WHEN why IS NULL THEN tokens ELSE 0 END, u1 + CASE WHEN took AND category = 'implementation' THEN tokens ELSE 0 END, u2 + CASE WHEN took AND category = 'tests' THEN tokens ELSE 0 END,
    u3 + CASE WHEN took AND category = 'documentation' THEN tokens ELSE 0 END, u4 + CASE WHEN took AND category = 'history' THEN tokens ELSE 0 END, ord, why FROM (
    SELECT *, why IS NULL AND policy_class <> 'hard' AS took FROM (
    SELECT s.request AS request, s.i AS i, used, u1, u2, u3, u4, s.ord AS ord, s.tokens AS tokens, s.category AS category, s.policy_class AS policy_class, CASE WHEN s.policy_class = 'hard' THEN NULL WHEN s.tokens > {BUDGET} * 0.7 THEN 'single item exceeds policy size limit'
      WHEN (s.category = 'implementation' AND u1 + s.tokens > floor({BUDGET} * 0.55)) OR (s.category = 'tests' AND u2 + s.tokens > floor({BUDGET} * 0.15)) OR (s.category = 'documentation' AND u3 + s.tokens > floor({BUDGET} * 0.1)) OR (s.category = 'history' AND u4 + s.tokens > floor({BUDGET} * 0.05)) THEN s.category || ' category budget'
      WHEN used + s.tokens > {BUDGET} THEN 'token budget' END AS why FROM fold JOIN s ON s.request = fold.request AND s.i = fold.i + 1))),
sel AS (SELECT c3.*, coalesce(early, why) AS reason_out, coalesce(early, why) IS NULL AS included FROM c3 LEFT JOIN (SELECT request, ord, why FROM fold WHERE i > 0) d USING (request, ord))"""


def _selected(spark, sf, contents=False):
    return policy.select_by_budget(project(spark, sf, "g_candidates"), BUDGET, contents=contents)


@query(_PREP + "SELECT request, ord, policy_class, category FROM c2")
def classify_candidate(spark, sf):
    return policy.prepare(project(spark, sf, "g_candidates"), policy.resolve_policy()).select("request", "ord", "policy_class", "category")


@query(_PREP + "SELECT ord, score, tokens FROM c2")
def score(spark, sf):
    return policy.prepare(project(spark, sf, "g_candidates"), policy.resolve_policy()).select("ord", "score", "tokens")


@query(_PREP + "SELECT request, ord, tokens, policy_class, included, reason_out FROM sel")
def budget_select(spark, sf):
    return _selected(spark, sf).select("request", "ord", "tokens", "policy_class", "included", "reason_out")


@query(_PREP + f""", v AS (SELECT request, 'error' AS severity, 'BUDGET_EXCEEDED' AS code, CAST(NULL AS VARCHAR) AS node, CAST(sum(tokens) AS BIGINT) AS n FROM sel WHERE included GROUP BY 1 HAVING sum(tokens) > {BUDGET}
UNION ALL SELECT request, 'error', 'STALE_HARD_CONTEXT', node, count(*) FROM sel WHERE included AND policy_class = 'hard' AND status IN ('resolved', 'deprecated', 'superseded', 'archived', 'stale') AND NOT force_include GROUP BY 1, 4
UNION ALL SELECT request, 'error', 'MISSING_HARD_CONTEXT', node, count(*) FROM sel WHERE NOT included AND policy_class = 'hard' GROUP BY 1, 4)
SELECT * FROM v""")
def validate_selection(spark, sf):
    return policy.validate_selection(_selected(spark, sf), BUDGET)


@query(_PREP + "SELECT request, node, coalesce(reason_out, reason) AS reason FROM sel")
def manifest_reasons(spark, sf):
    return policy.manifest_reasons(_selected(spark, sf))


@query(_PREP + "SELECT request, CAST(sum(tokens) AS BIGINT) AS candidate_tokens, CAST(coalesce(sum(tokens) FILTER (WHERE included), 0) AS BIGINT) AS selected_tokens, CAST(coalesce(sum(tokens) FILTER (WHERE NOT included), 0) AS BIGINT) AS excluded_tokens, CAST(sum(included::INT) AS BIGINT) AS n_included, count(*) AS n_candidates FROM sel GROUP BY 1")
def audit_totals(spark, sf):
    return policy.audit_totals(_selected(spark, sf))


@query(_PREP + ", p AS (SELECT request, string_agg('## ' || label || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY CASE policy_class WHEN 'hard' THEN 0 WHEN 'soft' THEN 1 ELSE 2 END, score DESC, priority DESC, ord) AS context FROM sel WHERE included GROUP BY 1) SELECT request, sha256(context) AS context_hash, sha256(CAST(request AS VARCHAR) || chr(0) || context) AS fingerprint FROM p")
def context_text(spark, sf):
    return policy.context_text(_selected(spark, sf, contents=True)).select("request", F.sha2("context", 256).alias("context_hash"), "fingerprint")


# The traversal's oracle is a walk over levels without forced edges on the way: depth and membership from one region.
_WALK = with_("g_nodes", "g_edges") + """, e AS (SELECT * FROM g_edges WHERE mode <> 'FORCE_EXCLUDE'), ty AS (SELECT id, type FROM g_nodes),
b AS (SELECT source AS a, target AS b, type FROM e UNION ALL SELECT target, source, type FROM e WHERE type NOT IN ('depends_on')),
st AS (SELECT b.* FROM b JOIN ty x ON x.id = b.a JOIN ty y ON y.id = b.b WHERE x.type = 'functional' AND NOT (b.type IN ('dependency', 'reference', 'calls')) AND y.type = 'functional'),
w(id, depth) AS (SELECT 'region:1', 0 UNION SELECT b, depth + 1 FROM w JOIN st ON st.a = w.id WHERE depth < 2)
SELECT id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY id"""


@query(_WALK)
def traverse_levels(spark, sf):
    n, e = project(spark, sf, "g_nodes"), project(spark, sf, "g_edges").where("mode <> 'FORCE_EXCLUDE'").withColumn("scope", F.lit(""))
    none = spark.createDataFrame([], "id string")
    limits = traverse.depth_limits(False, policy.resolve_policy())
    return traverse.traverse(n, e, project(spark, sf, "g_items"), "region:1", limits, none, none)[0].select("id", "depth")


@query(with_("g_items") + """, o AS (SELECT DISTINCT impl_id AS id FROM g_items WHERE mode = 'FORCE_EXCLUDE' AND functional IN ('nation:1', 'nation:2', 'nation:3', 'nation:7')), i AS (SELECT DISTINCT impl_id AS id FROM g_items WHERE mode = 'FORCE_INCLUDE' AND functional IN ('nation:1', 'nation:2', 'nation:3', 'nation:7'))
SELECT id, 'exclude' AS verdict FROM o UNION ALL SELECT id, 'include' FROM i WHERE id NOT IN (SELECT id FROM o)""")
def mapping_overrides(spark, sf):
    ids = spark.createDataFrame([(f"nation:{k}",) for k in (1, 2, 3, 7)], "id string")
    none = spark.createDataFrame([], "id string")
    out, into = traverse.mapping_overrides(ids, project(spark, sf, "g_items"), none, none)
    return out.withColumn("verdict", F.lit("exclude")).unionByName(into.withColumn("verdict", F.lit("include")))


@query(with_("g_nodes", "g_edges") + """, d(file, id) AS (SELECT id, id FROM g_nodes WHERE type = 'functional' AND id LIKE 'nation:%' UNION SELECT file, target FROM d JOIN g_edges ON source = d.id AND type = 'contains'),
h AS (SELECT file, n.id AS symbol, (CASE WHEN contains(lower(n.id || ' ' || title || ' ' || title || ' '), '0007') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(n.id || ' ' || title), 'supplier') THEN 1 ELSE 0 END) AS hits FROM d JOIN g_nodes n ON n.id = d.id WHERE file <> d.id),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY hits DESC, symbol) AS rk FROM h WHERE hits > 0) SELECT file, symbol, CAST(hits AS INT) AS hits, CAST(rk AS INT) AS rank FROM r WHERE rk <= 3""")
def symbol_narrow(spark, sf):
    n = project(spark, sf, "g_nodes").withColumns({"label": F.col("title"), "signature": F.lit("")})
    return traverse.symbol_narrowing(n.where("id like 'nation:%'"), n, project(spark, sf, "g_edges"), F.array(F.lit("0007"), F.lit("supplier")))


@query()
def compile_context(spark, sf):
    n = project(spark, sf, "g_nodes").withColumns({"content": F.concat(F.lit("About "), "title"), "description": F.col("title"), "priority": F.lit("normal"), "raw": F.lit(False), "code": F.concat(F.lit("code of "), "title")})
    e = project(spark, sf, "g_edges").withColumn("scope", F.lit(""))
    none = spark.createDataFrame([], "id string")
    got, _ = traverse.compile_context(n, e, project(spark, sf, "g_items"), "nation:1", "Check supplier code", 2000, none, none)
    return got.select("node", "label", "tokens", "policy_class", "included", "reason_out")


# What each session gets, in SQL of its own: texts are known, so targets and exclusions are read off them; walks are a recursion by session.
_TURNS = with_("g_nodes", "g_edges", "g_items", "g_turns", "g_settings") + f""", last AS (SELECT session, trim(arg_max(text, pos)) AS text FROM g_turns WHERE role = 'user' AND kind NOT IN ('plugin', 'tool') GROUP BY 1),
v AS (SELECT l.session, l.text, semanticDepth AS depth, one_in, one_out, l.session % 6 AS k, CASE l.session % 6 WHEN 0 THEN 'nation:6' WHEN 1 THEN CASE WHEN 'nation:' || (l.session % 25) IN ('nation:7', one_out) THEN NULL ELSE 'nation:' || (l.session % 25) END
    WHEN 4 THEN 'region:2' WHEN 5 THEN 'customer:1' END AS target FROM last l JOIN g_settings s ON s.session = l.session),
x AS (SELECT session, 'nation:7' AS id FROM v WHERE k = 1 UNION SELECT session, one_out FROM v WHERE one_out <> '' UNION SELECT session, n.id FROM v, g_nodes n WHERE n.mode = 'FORCE_EXCLUDE'),
e AS (SELECT source, target, type FROM g_edges WHERE mode <> 'FORCE_EXCLUDE' UNION ALL SELECT 'supplier:' || (c_custkey % 10 + 1), 'customer:' || c_custkey, 'contains' FROM customer),
b AS (SELECT source AS a, target AS b, type FROM e UNION ALL SELECT target, source, type FROM e WHERE type <> 'depends_on'),
st AS (SELECT DISTINCT b.a, b.b, n.type = 'functional' AS onward FROM b JOIN g_nodes m ON m.id = b.a JOIN g_nodes n ON n.id = b.b WHERE m.type <> 'functional' OR (n.type = 'functional' AND b.type NOT IN ('dependency', 'reference', 'calls'))),
w(session, id, depth, onward) AS (SELECT session, target, 0, TRUE FROM v WHERE target IS NOT NULL
  UNION SELECT w.session, st.b, w.depth + 1, st.onward FROM w JOIN v ON v.session = w.session JOIN st ON st.a = w.id LEFT JOIN x ON x.session = w.session AND x.id = st.b LEFT JOIN x y ON y.session = w.session AND y.id = w.id
    WHERE w.onward AND x.id IS NULL AND y.id IS NULL AND w.depth < least(v.depth, 2)),
c0 AS (SELECT w.session, w.id, min(w.depth) AS depth, CASE WHEN w.id = any_value(target) THEN 'content,code' ELSE '' END AS scope FROM w JOIN v USING (session) GROUP BY 1, 2),
mine AS (SELECT v.session, g_items.*, text FROM v JOIN g_items ON functional = target),
x2 AS (SELECT session, id FROM x UNION SELECT session, impl_id FROM mine WHERE mode = 'FORCE_EXCLUDE'),
f AS (SELECT * FROM (SELECT session, one_in AS id FROM v WHERE target IS NOT NULL AND one_in <> '' UNION SELECT session, impl_id FROM mine WHERE mode = 'FORCE_INCLUDE') ANTI JOIN x2 USING (session, id)),
pick AS (SELECT session, impl_id AS id, row_number() OVER (PARTITION BY session ORDER BY ord) AS rk FROM mine),
c1 AS (SELECT session, id, depth, scope FROM c0 UNION ALL SELECT session, id, 1, 'code,interface' FROM pick ANTI JOIN c0 USING (session, id) WHERE rk <= 2),
c2 AS (SELECT * FROM c1 ANTI JOIN x2 USING (session, id)),
sym AS (SELECT c2.session, c2.id AS file, c2.depth, 'customer:' || c_custkey AS id, row_number() OVER (PARTITION BY c2.session, c2.id ORDER BY 'customer:' || c_custkey) AS rk FROM c2 JOIN v USING (session) JOIN customer ON c2.id = 'supplier:' || (c_custkey % 10 + 1) WHERE contains(scope, 'code') AND contains(text, 'desk')),
c3 AS (SELECT session, id, depth, CASE WHEN (session, id) IN (SELECT (session, file) FROM sym) THEN 'interface' ELSE scope END AS scope FROM c2
  UNION ALL SELECT session, id, max(depth) + 1, 'code,interface' FROM sym ANTI JOIN c2 USING (session, id) WHERE rk <= 3 GROUP BY 1, 2),
c4 AS (SELECT session, id, CASE WHEN f.id IS NULL THEN depth ELSE 0 END AS depth, CASE WHEN f.id IS NULL THEN scope ELSE 'code' END AS scope, f.id IS NOT NULL AS forced FROM c3 FULL JOIN f USING (session, id)),
n AS (SELECT c4.*, g.type, g.title, text, id = target AS is_entry FROM c4 JOIN g_nodes g USING (id) JOIN v USING (session) WHERE g.status = 'active' OR forced),
o AS (SELECT session AS request, id AS node, depth, title || ' (' || type || ')' AS label, CASE WHEN type = 'functional' THEN title ELSE 'About ' || title END AS content, is_entry OR forced AS hard FROM n
  UNION ALL SELECT session, id, depth, title || ' code', 'code of ' || title, forced FROM n WHERE type <> 'functional' AND contains(scope, 'code')
  UNION ALL SELECT session, target, 1, 'User task', text, TRUE FROM v WHERE target IS NOT NULL)
"""


def _turn_graph(spark, sf):
    n = project(spark, sf, "g_nodes")
    label = F.when(F.col("type") == "implementation_symbol", F.concat(F.lit("Desk "), (F.split("id", ":")[1].cast("int") % 10).cast("string"))).otherwise(F.col("title"))
    n = n.withColumns({"label": label, "content": F.concat(F.lit("About "), "title"), "description": F.col("title"), "priority": F.lit("normal"), "raw": F.lit(False), "code": F.concat(F.lit("code of "), "title"), "signature": F.lit("")})
    more = read(spark, sf, "customer").select((F.lit(20_000_000) + F.col("c_custkey")).cast("bigint").alias("ord"), F.concat(F.lit("supplier:"), (F.col("c_custkey") % 10 + 1).cast("string")).alias("source"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("target"), F.lit("contains").alias("type"), F.lit("AUTO").alias("mode"))
    e = project(spark, sf, "g_edges").where("mode <> 'FORCE_EXCLUDE'").unionByName(more).withColumn("scope", F.lit(""))
    one = lambda c: F.when(F.col(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    settings = project(spark, sf, "g_settings").withColumns({"include": one("one_in"), "exclude": one("one_out")})
    return project(spark, sf, "g_turns"), n, e, project(spark, sf, "g_items"), settings


@query(_TURNS + """SELECT session, CASE WHEN k = 2 THEN 'EXCLUSION_AMBIGUOUS' WHEN target IS NULL THEN 'TARGET_REQUIRED' END AS code, k <> 2 AND target IS NULL AS fallback, target,
  CASE WHEN k = 2 THEN 'desk 3' ELSE '' END AS aliases, CASE WHEN k = 2 THEN (SELECT count(*) FROM customer WHERE c_custkey % 10 = 3) ELSE 0 END AS n_options, array_to_string(list_sort(list_filter([CASE WHEN k = 1 THEN 'nation:7' END, nullif(one_out, '')], lambda x: x IS NOT NULL)), ',') AS excluded FROM v""")
def turn_verdicts(spark, sf):
    messages, n, _, _, settings = _turn_graph(spark, sf)
    v = turns.turn_verdicts(messages, n, settings)
    return v.select("session", "code", "fallback", "target", F.array_join("aliases", ",").alias("aliases"), "n_options", F.array_join("force_exclude", ",").alias("excluded"))


@query(_TURNS + f"SELECT request, node, label, CAST(depth AS INT) AS depth, {tokens_sql('content')} + {tokens_sql('label')} + 10 AS tokens, CASE WHEN hard THEN 'hard' ELSE 'soft' END AS policy_class, TRUE AS included, content FROM o")
def turn_selection(spark, sf):
    return turns.compile_turns(*_turn_graph(spark, sf))[1].select("request", "node", "label", "depth", "tokens", "policy_class", "included", "content")


@query(with_("g_nodes", "g_edges", "g_items") + """, x AS (SELECT 'region:3' AS id UNION SELECT id FROM g_nodes WHERE mode = 'FORCE_EXCLUDE' UNION SELECT target FROM g_edges WHERE mode = 'FORCE_EXCLUDE' UNION SELECT impl_id FROM g_items WHERE mode = 'FORCE_EXCLUDE'),
r(id) AS (SELECT id FROM x UNION SELECT target FROM g_edges JOIN r ON source = r.id WHERE type = 'contains') SELECT id FROM r WHERE id IN (SELECT id FROM g_nodes)""")
def exclusion_closure(spark, sf):
    n, e = project(spark, sf, "g_nodes"), project(spark, sf, "g_edges")
    stated = spark.createDataFrame([("region:3",)], "id string")
    return provider.exclusion_closure(n, e, provider.exclusion_set(n, e, project(spark, sf, "g_items"), stated))


@query("""WITH s AS (SELECT 'c' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS sig, p_brand AS module FROM part), h AS (SELECT *, (CASE WHEN contains(lower(id || ' ' || name || ' ' || sig || ' '), 'steel') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(id || ' ' || name || ' ' || sig || ' '), 'c1') THEN 1 ELSE 0 END) AS hits FROM s WHERE module = 'Brand#1')
SELECT id, 'symbol' AS kind, CAST(860 + least(50, hits * 10) AS INT) AS priority, CASE WHEN hits > 0 THEN 'task-relevant symbol' ELSE 'module symbol' END AS reason FROM h WHERE id <> 'c100'""")
def provider_candidates(spark, sf):
    p = read(spark, sf, "part")
    s = p.select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("signature"), F.lit("").alias("path"), F.col("p_brand").alias("module"))
    return provider.module_candidates(s, "Brand#1", F.array(F.lit("steel"), F.lit("c1")), spark.createDataFrame([("c100",)], "id string"))


@query()
def provider_fill(spark, sf):
    c = project(spark, sf, "g_candidates").where("content is not null")
    rows = c.select("request", F.col("node").alias("id"), F.when(F.col("ord") % 10 == 0, "file").otherwise("symbol").alias("kind"), "priority", "label", "content", (F.col("ord") % 23 == 0).alias("exact"))
    return provider.fill_budget(rows, 3000)


@query(with_("g_messages") + """, l AS (SELECT session, max(pos) AS last FROM g_messages WHERE role = 'user' AND kind NOT IN ('plugin', 'tool', 'client-input') GROUP BY 1)
SELECT m.session AS session, pos FROM g_messages m LEFT JOIN l USING (session) WHERE CASE WHEN coalesce(form, '') = 'instructions' THEN kind <> 'plugin' OR coalesce(plugin, '') = 'notes' WHEN role <> 'user' THEN FALSE WHEN kind = 'plugin' THEN FALSE WHEN kind IN ('tool', 'client-input') THEN TRUE ELSE pos = last END""")
def message_filter(spark, sf):
    return firewall.filter_messages(project(spark, sf, "g_messages"), ["notes"]).select("session", "pos")


@query(with_("g_messages") + f"SELECT session, count(*) AS n_messages, CAST(sum(CASE WHEN kind = 'plugin' AND plugin = 'loom-context' THEN 1 ELSE 0 END) AS BIGINT) AS n_snapshots, CAST(sum(CASE WHEN kind = 'plugin' AND plugin <> 'loom-context' AND coalesce(form, '') <> 'instructions' THEN 1 ELSE 0 END) AS BIGINT) AS n_foreign, CAST(sum({tokens_sql('text')} + 6) AS BIGINT) AS message_tokens, CAST(sum({tokens_sql('text')} + 6) + 150 AS BIGINT) AS final_tokens FROM g_messages GROUP BY 1")
def message_tokens(spark, sf):
    return firewall.inspect_request(project(spark, sf, "g_messages"), 100, 50)


@query(with_("g_messages") + f""", t AS (SELECT session, sum(CASE WHEN kind = 'plugin' AND plugin = 'loom-context' THEN 1 ELSE 0 END) AS ns, sum(CASE WHEN kind = 'plugin' AND plugin <> 'loom-context' AND coalesce(form, '') <> 'instructions' THEN 1 ELSE 0 END) AS nf, sum({tokens_sql('text')} + 6) AS tk FROM g_messages GROUP BY 1)
SELECT session, 'SNAPSHOT_COUNT' AS code, CAST(ns AS BIGINT) AS n FROM t WHERE ns <> 1 UNION ALL SELECT session, 'FOREIGN_PLUGIN', CAST(nf AS BIGINT) FROM t WHERE nf > 0
UNION ALL SELECT session, 'BUDGET', CAST(ceil(tk * CAST(1.15 AS DOUBLE)) AS BIGINT) + 256000 FROM t WHERE ceil(tk * CAST(1.15 AS DOUBLE)) + 256000 > 256800
UNION ALL SELECT session, 'MESSAGE_MISMATCH', count(*) FROM g_messages WHERE ord % 13 = 0 GROUP BY session""")
def request_audit(spark, sf):
    m = project(spark, sf, "g_messages")
    return firewall.audit_request(m.withColumn("text", F.when(F.col("ord") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), m, 256_800)


@query("SELECT conv_id, turn, CASE WHEN 4000 - ceil(length(text) * CAST(1.15 AS DOUBLE)) >= 1 THEN CAST(least(2000, 4000 - ceil(length(text) * CAST(1.15 AS DOUBLE))) AS BIGINT) END AS clamped FROM conversations")
def clamp_output(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", firewall.clamp_output(F.length("text"), F.lit(4000), F.lit(2000)).alias("clamped"))


@query(with_("g_events") + """, s AS (SELECT user_id AS session, event_id AS pos, event_id + CASE WHEN event_id % 501 = 0 THEN 1000000000 ELSE 0 END AS seq FROM events), j AS (SELECT s.*, e.type AS type, role FROM s LEFT JOIN g_events e ON e.session = s.session AND e.seq = s.seq)
SELECT session, pos, seq, role FROM j WHERE type IN ('user/message', 'assistant/message', 'tool/result') AND session NOT IN (SELECT session FROM j WHERE type IS NULL)""")
def surface_projection(spark, sf):
    e = read(spark, sf, "events")
    surface = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), (F.col("event_id") + F.when(F.col("event_id") % 501 == 0, 1_000_000_000).otherwise(0)).alias("seq"))
    return firewall.surface_projection(project(spark, sf, "g_events"), surface).drop("text")


@query("SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN '## Rules' || chr(10) || chr(10) || 'Be kind' || chr(10) || chr(10) || '## Code' || chr(10) || chr(10) || 'x' END AS context FROM conversations")
def strip_task(spark, sf):
    c = read(spark, sf, "conversations")
    context = F.concat(F.lit("## Rules\n\nBe kind\n\n## User task\n\n"), F.col("text"), F.lit("\n\n## Code\n\nx"))
    return c.select("conv_id", "turn", firewall.without_task(context, F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("")).alias("context"))


@query(with_("g_messages") + """, f AS (SELECT session, pos, sha256('{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text) || ',' END || '"role":"' || role || '","source":{' || CASE WHEN form IS NULL THEN '' ELSE '"form":"' || form || '",' END || '"kind":"' || kind || '"' || CASE WHEN plugin IS NULL THEN '' ELSE ',"plugin":"' || plugin || '"' END || '}}') AS f FROM g_messages)
SELECT session, sha256(string_agg(f, ',' ORDER BY pos)) AS fingerprint, CAST(count(*) AS INT) AS n FROM f GROUP BY session""")
def message_fingerprint(spark, sf):
    return firewall.list_fingerprint(project(spark, sf, "g_messages"))

"""Smaller operators over the projections, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents, firewall, index, infer, knowledge, policy, provider, reconcile, store, target, views
from .compile_queries import _PREP, BUDGET, _selected
from .projections import project, read, with_
from .registry import query


def _over(spark, sf, sql, table):
    """One of the SELECTs below, over a table of the driver."""
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: read(spark, sf, table)})


@query(with_("g_nodes") + " SELECT 'nation_' || k AS domain, count(*) AS n_members, min(ord) AS first, 'Nation ' || k AS title, 'function.nation-' || k AS functional FROM (SELECT ord, regexp_extract(path, 'nation_([0-9]+)/', 1) AS k FROM g_nodes WHERE type IN ('code_module', 'implementation_symbol') AND status = 'active') GROUP BY k")
def functional_titles(spark, sf):
    return infer.functional_titles(infer.capability_groups(project(spark, sf, "g_nodes")))


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(': ' || text || '!? ', '^\s+|\s+$', '', 'g'), '^[：:，,\s]+|[。.!！?？\s]+$', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) > 48 THEN substring(t, 1, 47) || '…' ELSE t END AS title FROM c""")
def clause_title(spark, sf):
    said = F.concat(F.lit(": "), "text", F.lit("!? "))
    return read(spark, sf, "conversations").select("conv_id", "turn", T.clause_title(said).alias("title"))


_FOUND = "SELECT 'part:' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 5 = 0 THEN 'part:' || CAST(p_partkey * 2 AS STRING) END AS supersedes FROM part"


@query(f"WITH f AS ({_FOUND}) SELECT 'part:' || p_partkey AS id, CASE WHEN 'part:' || p_partkey IN (SELECT supersedes FROM f WHERE supersedes IS NOT NULL) THEN 'superseded' WHEN p_partkey % 3 = 0 THEN 'stale' ELSE 'active' END AS status FROM part")
def apply_superseded(spark, sf):
    p = read(spark, sf, "part")
    known = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 3 == 0, "stale").otherwise("active").alias("status"))
    return knowledge.apply_superseded(known, _over(spark, sf, _FOUND, "part")).select("id", "status")


@query(with_("g_turns") + " SELECT session * 1000 + pos AS task_id, CASE session % 6 WHEN 0 THEN 'nation:6' WHEN 1 THEN CASE WHEN session % 25 < 10 THEN least('nation:' || session % 25, 'nation:7') ELSE 'nation:' || session % 25 END WHEN 2 THEN 'region:1' WHEN 5 THEN 'customer:1' END AS target FROM g_turns")
def target_cascade(spark, sf):
    n = project(spark, sf, "g_nodes").withColumn("label", F.col("title"))
    return target.target_cascade(project(spark, sf, "g_turns").select((F.col("session") * 1000 + F.col("pos")).alias("task_id"), "text"), n)


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;')"


@query(f"""SELECT page_id, sha256({_ESC.format('html')}) AS escaped, '<loom-context target="' || {_ESC.format('url')} || '" tokens="' || length(html) || '">' || chr(10) || url || chr(10) || '</loom-context>' AS snapshot FROM pages WHERE html IS NOT NULL AND url IS NOT NULL""")
def snapshot_texts(spark, sf):
    p = read(spark, sf, "pages").where("html is not null and url is not null")
    return p.select("page_id", F.sha2(target.escape_attribute(F.col("html")), 256).alias("escaped"), firewall.snapshot_text(F.col("url"), F.length("html"), F.col("url")).alias("snapshot"))


_SYM = "SELECT p_partkey AS ord, 'm.' || CAST(p_partkey % 30 AS STRING) AS module, CASE WHEN p_partkey % 2 = 0 THEN 'T' || CAST(p_size AS STRING) || '.f' || CAST(p_partkey AS STRING) ELSE 'g' || CAST(p_partkey AS STRING) END AS name, CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE '' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 7 END AS line, CASE WHEN p_partkey % 6 = 0 THEN 3 END AS end_line FROM part"


@query(f"""WITH s AS ({_SYM}) SELECT ord, module || ':' || name AS id, regexp_extract(name, '[^.]*$') AS short_name, CASE WHEN contains(name, '.') THEN module || ':' || regexp_extract(name, '^(.*)\\.[^.]*$', 1) ELSE module END AS container, coalesce(line, 1) AS start_line, greatest(coalesce(line, 1), coalesce(end_line, 1)) AS end_line,
  CASE kind WHEN 'class' THEN 'implementation_class' WHEN '' THEN 'implementation_symbol' ELSE 'implementation_function' END AS type FROM s""")
def normalize_symbols(spark, sf):
    return index.normalize_symbols(_over(spark, sf, _SYM, "part")).select("ord", "id", "short_name", "container", "start_line", "end_line", index.symbol_node_type(F.col("kind")).alias("type"))


_TOTALS = "t AS (SELECT request, CAST(sum(tokens) AS BIGINT) AS candidate_tokens, CAST(coalesce(sum(tokens) FILTER (WHERE included), 0) AS BIGINT) AS selected_tokens, CAST(coalesce(sum(tokens) FILTER (WHERE NOT included), 0) AS BIGINT) AS excluded_tokens, CAST(sum(included::INT) AS BIGINT) AS n_included, count(*) AS n_candidates FROM sel GROUP BY 1)"


@query(_PREP + f", {_TOTALS} SELECT request, CAST(round(CAST(selected_tokens AS DOUBLE) / {BUDGET}, 4) AS DOUBLE) AS used_share, n_candidates - n_included AS left_out, selected_tokens <= {BUDGET} AS valid FROM t")
def manifest_metrics(spark, sf):
    return views.manifest_metrics(policy.audit_totals(_selected(spark, sf)), BUDGET).select("request", "used_share", "left_out", "valid")


@query(_PREP + f", {_TOTALS} SELECT t.*, CASE WHEN request % 3 = 0 THEN 0 ELSE request * 100 END AS final_tokens FROM t")
def audit_record(spark, sf):
    selected = _selected(spark, sf)
    final = selected.where("request % 3 <> 0").select("request", (F.col("request") * 100).alias("final_tokens")).distinct()
    return firewall.audit_record(selected, final)


@query(with_("g_candidates") + " SELECT ord, CASE WHEN ord % 7 = 0 THEN '.context/project.md' WHEN ord % 7 = 1 THEN 'current request' WHEN scope = 'code' AND ord % 3 = 0 THEN 'src/x' WHEN ord % 5 = 0 THEN 'me' WHEN ord % 3 = 0 THEN 'src/x' ELSE 'graph' END AS source FROM g_candidates")
def display_source(spark, sf):
    c = project(spark, sf, "g_candidates").select("ord", F.when(F.col("ord") % 7 == 0, "project").when(F.col("ord") % 7 == 1, "task").otherwise(F.col("scope")).alias("scope"), F.when(F.col("ord") % 3 == 0, "src/x").alias("path"), F.when(F.col("ord") % 5 == 0, "me").otherwise("").alias("own"))
    return c.select("ord", store.display_source(F.col("scope"), F.col("path"), F.col("own")).alias("source"))


@query(with_("g_outline") + " SELECT doc_id, idx, greatest(level - 2, 1) AS level, least(greatest(page_start - 3, 1), 6) AS page_start, least(greatest(coalesce(CASE WHEN idx % 2 = 0 THEN idx * 3 END, least(greatest(page_start - 3, 1), 6)), least(greatest(page_start - 3, 1), 6)), 6) AS page_end FROM g_outline")
def clean_outline(spark, sf):
    g = project(spark, sf, "g_outline").withColumns({"level": F.col("level") - 2, "page_start": F.col("page_start") - 3, "page_end": F.when(F.col("idx") % 2 == 0, F.col("idx") * 3)})
    return documents.clean_outline(g, F.lit(6)).select("doc_id", "idx", "level", "page_start", "page_end")


@query(with_("g_nodes", "g_edges", "g_items") + """, x AS (SELECT id FROM g_nodes WHERE ord % 13 = 5) SELECT 'node' AS kind, id AS a, '' AS b FROM g_nodes WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT 'edge', source, target FROM g_edges WHERE source NOT IN (SELECT id FROM x) AND target NOT IN (SELECT id FROM x)
UNION ALL SELECT 'item', functional, impl_id FROM g_items WHERE impl_id NOT IN (SELECT id FROM x)""")
def drop_tombstoned(spark, sf):
    n, e, i = (project(spark, sf, g) for g in ("g_nodes", "g_edges", "g_items"))
    n, e, i = reconcile.drop_tombstoned(n, e, i, n.where("ord % 13 = 5").select("id"))
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else F.lit("")).alias("b"))
    return row(n, "node", "id", None).unionByName(row(e, "edge", "source", "target")).unionByName(row(i, "item", "functional", "impl_id"))


@query(with_("g_nodes", "g_edges") + " SELECT o AS id, min(ord) AS ord, any_value(type) AS type FROM (SELECT e.ord AS ord, CASE WHEN source = 'nation:1' THEN target ELSE source END AS o FROM g_edges e WHERE 'nation:1' IN (source, target)) JOIN (SELECT id, type FROM g_nodes) ON id = o GROUP BY 1")
def functional_neighbors(spark, sf):
    return provider.functional_neighbors(project(spark, sf, "g_nodes"), project(spark, sf, "g_edges"), "nation:1").select("id", "ord", "type")


_PATHS = "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'a/test/b/' WHEN 3 THEN 'latest/' WHEN 4 THEN '' END || CASE p_partkey % 5 WHEN 0 THEN 'test_' WHEN 1 THEN 'Test_' ELSE '' END || p_brand || CASE WHEN p_partkey % 4 = 0 THEN '_test' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '.py' ELSE '' END AS path FROM part"


@query(f"WITH p AS ({_PATHS}) SELECT id, path IS NOT NULL AND (id % 7 IN (1, 2) OR (id % 3 = 0 AND (id % 5 < 2 OR id % 4 = 0))) AS is_test FROM p")
def test_paths(spark, sf):
    return _over(spark, sf, _PATHS, "part").select("id", T.is_test_path(F.col("path")).alias("is_test"))


@query(with_("g_candidates") + """, c AS (SELECT request, CASE WHEN ord % 11 = 0 THEN 'twice' ELSE node END AS node, scope, CASE WHEN ord % 11 = 0 THEN 'same' ELSE label END AS label, node_type FROM g_candidates), x AS (SELECT DISTINCT node FROM g_candidates WHERE ord % 29 = 3)
SELECT request, 'FORCE_EXCLUDED' AS code, count(*) AS n FROM c WHERE node IN (SELECT node FROM x) GROUP BY 1 UNION ALL SELECT request, 'RAW_CONVERSATION', count(*) FROM c WHERE node_type = 'conversation' GROUP BY 1
UNION ALL SELECT request, 'DUPLICATE_ENTRY', count(*) FROM (SELECT request, node, scope, label FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY 1""")
def validate_result(spark, sf):
    c = project(spark, sf, "g_candidates")
    some = F.col("ord") % 11 == 0
    taken = c.select("request", F.when(some, "twice").otherwise(F.col("node")).alias("node"), "scope", F.when(some, "same").otherwise(F.col("label")).alias("label"), "node_type")
    return firewall.validate_result(taken, c.where("ord % 29 = 3").select(F.col("node").alias("id")))


@query("SELECT conv_id, turn, conv_id % 3 <> 1 AND turn > 2 AS same FROM conversations")
def same_turn(spark, sf):
    c = read(spark, sf, "conversations")
    before = F.when(F.col("conv_id") % 3 == 0, F.col("conv_id")).when(F.col("conv_id") % 3 == 1, F.lit(None)).otherwise(F.col("conv_id"))
    return c.select("conv_id", "turn", firewall.same_turn(before, F.col("conv_id"), F.lit(2), F.col("turn")).alias("same"))


@query("WITH a AS (SELECT 'm' || p_partkey AS id, p_brand AS path, p_name AS symbols FROM part WHERE p_partkey % 2 = 0), b AS (SELECT 'm' || p_partkey AS id, p_type AS path, p_container AS symbols FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(a.id, b.id) AS id, coalesce(a.path, b.path) AS path, coalesce(b.symbols, a.symbols) AS symbols FROM a FULL JOIN b ON a.id = b.id".replace("p_container", "p_type || '!'"))
def merge_facts(spark, sf):
    p = read(spark, sf, "part").withColumn("id", F.concat(F.lit("m"), F.col("p_partkey").cast("string")))
    return index.merge_facts(p.where("p_partkey % 2 = 0").select("id", F.col("p_brand").alias("path"), F.col("p_name").alias("symbols")), p.where("p_partkey % 3 = 0").select("id", F.col("p_type").alias("path"), F.concat("p_type", F.lit("!")).alias("symbols")))

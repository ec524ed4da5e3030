"""Fact, index, reconciliation and view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, index, reconcile, views
from .projections import project, read, with_
from .registry import query

FACT = with_("g_facts")


@query(with_("g_nodes") + "SELECT ord, id, path FROM g_nodes WHERE type = 'code_module'")
def module_discover(spark, sf):
    return facts.discover_modules(project(spark, sf, "g_nodes").where("type = 'code_module'"))


@query(FACT + """SELECT ord, "from", "to", type, symbol FROM g_facts WHERE "from" = 'supplier:3' OR "to" = 'supplier:3'""")
def module_analyze(spark, sf):
    return facts.analyze_module(project(spark, sf, "g_facts"), "supplier:3").select("ord", "from", "to", "type", "symbol")


@query(FACT + """SELECT ord, "to", type FROM g_facts WHERE "from" = 'customer:7'""")
def deps_out(spark, sf):
    return facts.dependencies_of(project(spark, sf, "g_facts"), "customer:7").select("ord", "to", "type")


@query(FACT + """SELECT ord, "from", confidence FROM g_facts WHERE type = 'CALL' AND (symbol = 'p42' OR symbol LIKE '%.p42')""")
def callers(spark, sf):
    return facts.find_callers(project(spark, sf, "g_facts"), "p42").select("ord", "from", "confidence")


@query(FACT + """SELECT ord, "to", symbol FROM g_facts WHERE type = 'CALL' AND (from_symbol = 'line3' OR from_symbol LIKE '%.line3')""")
def callees(spark, sf):
    return facts.find_callees(project(spark, sf, "g_facts"), "line3").select("ord", "to", "symbol")


@query(FACT + """SELECT DISTINCT m AS module FROM (SELECT "to" AS m FROM g_facts WHERE "from" = 'customer:7' AND "to" <> '?' AND "to" <> "from" UNION ALL SELECT "from" FROM g_facts WHERE "to" = 'customer:7')""")
def related_modules(spark, sf):
    return facts.related_modules(project(spark, sf, "g_facts"), "customer:7")


@query(FACT + """SELECT ord, symbol FROM g_facts WHERE "from" = 'customer:11' AND type = 'CALL'""")
def interface_extract(spark, sf):
    contracts = project(spark, sf, "g_facts").where("type = 'CALL'").withColumnRenamed("from", "module")
    return facts.extract_interface(contracts, "customer:11").select("ord", "symbol")


@query(with_("g_facts", "g_edges") + """, b AS (SELECT "from" AS source, "to" AS target, count(*) AS n, max(confidence) AS c FROM g_facts GROUP BY 1, 2)
SELECT e.source AS source, e.target AS target, n IS NOT NULL AS supported, coalesce(n, 0) AS n_facts, coalesce(c, 0.0) AS confidence FROM g_edges e LEFT JOIN b USING (source, target)""")
def edge_validate(spark, sf):
    return facts.validate_edges(project(spark, sf, "g_edges"), project(spark, sf, "g_facts"))


_PROPOSE = """ok AS (SELECT * FROM g_facts WHERE "to" <> '?' AND "from" <> "to" AND confidence >= 0.6 AND type <> 'OPTIONAL_DEPENDENCY'),
best AS (SELECT *, row_number() OVER (PARTITION BY "from", "to" ORDER BY confidence DESC, ord) AS rk FROM ok),
prop AS (SELECT "from", "to", CASE WHEN type IN ('CALL', 'INHERIT', 'INTERFACE') THEN 'interface' ELSE 'reference' END AS proposed_type, CASE WHEN type IN ('CALL', 'INHERIT', 'INTERFACE') THEN 'interface,context' ELSE 'interface' END AS recommended_scope,
  confidence, "from" || ' ' || lower(type) || 's ' || symbol AS reason FROM best WHERE rk = 1)"""


@query(FACT + f", {_PROPOSE} SELECT * FROM prop")
def edge_propose(spark, sf):
    return facts.propose_edges(project(spark, sf, "g_facts"))


_MANUAL = "(upper(coalesce(mode, '')) IN ('MANUAL', 'FORCE_INCLUDE', 'FORCE_EXCLUDE') OR lower(type) IN ('force_include', 'force_exclude'))"
_CONSISTENT = _PROPOSE + f""", rep AS (
SELECT 'missing' AS category, 1 AS rank, CAST(NULL AS BIGINT) AS ord, "from" AS source, "to" AS target FROM prop WHERE NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.source = prop."from" AND e.target = prop."to")
UNION ALL SELECT 'stale', 2, ord, source, target FROM g_edges e WHERE NOT {_MANUAL} AND type IN ('dependency', 'reference', 'interface', 'data', 'optional') AND NOT EXISTS (SELECT 1 FROM g_facts f WHERE f."from" = e.source AND f."to" = e.target)
UNION ALL SELECT 'protected', 3, ord, source, target FROM g_edges WHERE {_MANUAL}
UNION ALL SELECT 'conflicts', 4, ord, source, target FROM g_edges e WHERE (mode = 'FORCE_EXCLUDE' OR type = 'force_exclude') AND EXISTS (SELECT 1 FROM g_facts f WHERE f."from" = e.source AND f."to" = e.target AND f.type IN ('CALL', 'INHERIT') AND f.confidence >= 0.9))"""


@query(with_("g_facts", "g_edges") + f", {_CONSISTENT} SELECT category, ord, source, target FROM rep")
def consistency(spark, sf):
    return facts.check_consistency(project(spark, sf, "g_facts"), project(spark, sf, "g_edges")).drop("rank")


@query(with_("g_facts", "g_edges") + f", {_CONSISTENT}" """, n AS (SELECT c.category AS category, c.rank AS rank, count(rep.category) AS n FROM (VALUES ('missing', 1), ('stale', 2), ('protected', 3), ('conflicts', 4)) c(category, rank)
  LEFT JOIN rep ON rep.category = c.category AND (source IN ('customer:7', 'nation:3') OR target IN ('customer:7', 'nation:3')) GROUP BY 1, 2)
SELECT category, n, CAST(least(n, greatest(0, 12 - coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS returned FROM n""")
def consistency_bounded(spark, sf):
    report = facts.check_consistency(project(spark, sf, "g_facts"), project(spark, sf, "g_edges"))
    return facts.bounded_consistency(report, ["customer:7", "nation:3"], 12)


_SPLIT_DAY = "1996-01-01"


@query(FACT + f""", k AS (SELECT DISTINCT "from", "to", type, symbol, day < TIMESTAMP '{_SPLIT_DAY}' AS old FROM g_facts WHERE "to" <> '?' AND "from" <> "to"),
b AS (SELECT "from", "to", type, symbol FROM k WHERE old), a AS (SELECT "from", "to", type, symbol FROM k WHERE NOT old)
SELECT 'added' AS change, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'removed', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def fact_diff(spark, sf):
    f = project(spark, sf, "g_facts")
    return facts.diff_relationships(f.where(f"day < timestamp '{_SPLIT_DAY}'"), f.where(f"day >= timestamp '{_SPLIT_DAY}'"))


# symbols: parts by brand (module), some of one short name
_SYMBOLS = """sym AS (SELECT 'm.' || replace(p_brand, '#', '_') AS module, p_partkey AS ord, 'Box' || CAST(p_size % 3 AS VARCHAR) || '.do_' || CAST(p_partkey % 700 AS VARCHAR) AS name FROM part),
full_ AS (SELECT module, ord, name, module || ':' || name AS id, string_split(name, '.')[-1] AS short, module || ':' || string_split(name, '.')[1] AS container FROM sym),
al AS (SELECT DISTINCT id, unnest([id, name, short, module || '.' || name]) AS alias FROM full_),
uq AS (SELECT alias, min(id) AS id FROM al GROUP BY alias HAVING count(DISTINCT id) = 1)"""


def _symbols(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.concat(F.lit("m."), F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("module"), F.col("p_partkey").alias("ord"), F.concat(F.lit("Box"), (F.col("p_size") % 3).cast("string"), F.lit(".do_"), (F.col("p_partkey") % 700).cast("string")).alias("name"))


@query(f"WITH {_SYMBOLS} SELECT alias, id FROM uq")
def unique_alias(spark, sf):
    return index.unique_aliases(index.alias_table(index.normalize_symbols(_symbols(spark, sf))))


_CALLS = """calls AS (SELECT ord, module, container, CASE ord % 4 WHEN 0 THEN short WHEN 1 THEN 'self.' || short WHEN 2 THEN name ELSE 'do_' || CAST((ord * 7) % 700 AS VARCHAR) END AS raw, CASE WHEN ord % 3 = 0 THEN 'm.Brand_1' ELSE '' END AS tm FROM full_),
bare AS (SELECT *, CASE WHEN starts_with(raw, 'self.') THEN string_split(container, ':')[-1] || '.' || raw[6:] ELSE raw END AS ws FROM calls),
tries AS (SELECT ord, unnest([raw, ws, CASE WHEN tm <> '' THEN tm || ':' || raw END, CASE WHEN tm <> '' THEN tm || '.' || raw END, module || ':' || ws, module || '.' || ws]) AS alias, unnest([0, 1, 2, 3, 4, 5]) AS rung FROM bare),
res AS (SELECT ord, min_by(id, rung) AS resolved FROM tries JOIN uq USING (alias) GROUP BY ord)"""


@query(f"WITH {_SYMBOLS}, {_CALLS} SELECT c.ord AS call, resolved FROM calls c LEFT JOIN res USING (ord)")
def call_resolve(spark, sf):
    full = index.normalize_symbols(_symbols(spark, sf))
    k = F.col("ord")
    raw = F.when(k % 4 == 0, F.col("short_name")).when(k % 4 == 1, F.concat(F.lit("self."), "short_name")).when(k % 4 == 2, F.col("name")).otherwise(F.concat(F.lit("do_"), (k * 7 % 700).cast("string")))
    calls = full.select(k.alias("call"), "module", "container", raw.alias("raw"), F.when(k % 3 == 0, "m.Brand_1").otherwise("").alias("target_module"))
    return index.resolve_calls(calls, index.unique_aliases(index.alias_table(full))).select("call", "resolved")


@query(with_("g_edges", "g_facts") + """, b AS (SELECT source, target, 'contains' AS type, CAST(1 AS DOUBLE) AS confidence, 0 AS k, ord FROM g_edges WHERE type = 'contains'
UNION ALL SELECT "from", "to", 'calls', confidence, 1, ord FROM g_facts WHERE type = 'CALL' UNION ALL SELECT "from", "to", 'calls', 0.55, 2, ord FROM g_facts WHERE type = 'REFERENCE')
SELECT source, target, type, arg_min(confidence, (k, ord)) AS confidence FROM b WHERE source <> target GROUP BY 1, 2, 3""")
def index_edges(spark, sf):
    e, f = project(spark, sf, "g_edges"), project(spark, sf, "g_facts")
    calls = lambda kind, c: f.where(F.col("type") == kind).select("ord", F.col("from").alias("source"), F.col("to").alias("target"), F.lit("calls").alias("type"), c.alias("confidence"))
    return index.index_edges([e.where("type = 'contains'").withColumn("confidence", F.lit(1.0)), calls("CALL", F.col("confidence")), calls("REFERENCE", F.lit(0.55))])


def _file_facts(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), F.col("l_linenumber").alias("part"), F.col("l_partkey").cast("string").alias("content"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"))


@query("""SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS file, sha256(string_agg(CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR))) AS hash, count(*) AS n_parts,
 array_to_string(list_sort(list(DISTINCT 'part:' || CAST(l_partkey AS VARCHAR))), ',') AS ids FROM lineitem GROUP BY l_orderkey""")
def file_state(spark, sf):
    return index.file_state(_file_facts(spark, sf))


@query("""WITH b AS (SELECT o_orderkey AS k, CAST(o_totalprice AS BIGINT) AS h FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_orderkey AS k, CAST(o_totalprice AS BIGINT) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS h FROM orders WHERE o_orderkey % 11 <> 0)
SELECT 'o' || CAST(coalesce(a.k, b.k) AS VARCHAR) AS file, CASE WHEN a.k IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def snapshot_diff(spark, sf):
    o = read(spark, sf, "orders")
    file, price = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("file"), F.round("o_totalprice").cast("bigint")
    before = o.where("o_orderkey % 7 <> 0").select(file, price.cast("string").alias("hash"))
    after = o.where("o_orderkey % 11 <> 0").select(file, (price + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).cast("string").alias("hash"))
    return index.snapshot_diff(before, after)


@query(FACT + """SELECT file, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM (SELECT file, 1 AS v FROM g_facts WHERE ord % 16 < 8 AND file NOT IN (SELECT file FROM g_facts WHERE day >= TIMESTAMP '1997-01-01') UNION ALL SELECT file, 2 FROM g_facts WHERE day >= TIMESTAMP '1997-01-01') GROUP BY file""")
def incremental_merge(spark, sf):
    f = project(spark, sf, "g_facts")
    now = f.where("day >= timestamp '1997-01-01'")
    merged = index.merge_incremental(f.where("ord % 16 < 8").select("file", F.lit(1).alias("v")), now.select("file", F.lit(2).alias("v")), now.select("file"))
    return merged.groupBy("file").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


_IMPORTS = r"""ids AS (SELECT DISTINCT 'pkg.' || replace(replace(p_brand, '#', '_'), 'Brand', 'b') || CASE WHEN p_partkey % 3 = 0 THEN '.m' || CAST(p_size AS VARCHAR) ELSE '' END AS id FROM part),
imp AS (SELECT DISTINCT 'x' || CAST(p_partkey % 50 AS VARCHAR) AS module, CASE p_partkey % 4 WHEN 0 THEN 'pkg.' || replace(replace(p_brand, '#', '_'), 'Brand', 'b') || '.m' || CAST(p_size AS VARCHAR) || '.deep' WHEN 1 THEN 'm' || CAST(p_size AS VARCHAR) || '.h'
  WHEN 2 THEN '.' || replace(replace(p_brand, '#', '_'), 'Brand', 'b') || '/m' || CAST(p_size AS VARCHAR) ELSE 'other.thing' END AS raw FROM part),
c AS (SELECT module, raw, replace(regexp_replace(raw, '^\.+', ''), '/', '.') AS a, regexp_replace(replace(regexp_replace(raw, '^\.+', ''), '/', '.'), '\.(h|hh|hpp|hxx|c|cc|cpp|cxx)$', '', 'i') AS b FROM imp),
d AS (SELECT module, raw, max_by(id, (CASE WHEN a = id OR starts_with(a, id || '.') THEN 10000 ELSE 0 END) + length(id)) AS direct FROM c JOIN ids ON a = id OR starts_with(a, id || '.') OR b = id OR starts_with(b, id || '.') GROUP BY 1, 2),
t AS (SELECT module, raw, array_to_string(string_split(b, '.')[1:n], '.') AS alias FROM c, unnest(range(1, len(string_split(b, '.')) + 1)) AS r(n)),
s AS (SELECT module, raw, alias, count(DISTINCT id) AS n, min(id) AS one FROM t JOIN ids ON ends_with(id, '.' || alias) GROUP BY 1, 2, 3),
u AS (SELECT module, raw, max_by(CASE WHEN n = 1 THEN one END, length(alias)) AS tail, arg_max(n, length(alias)) AS n FROM s GROUP BY 1, 2)"""


@query(f"WITH {_IMPORTS} SELECT c.module AS module, c.raw AS raw, coalesce(direct, CASE WHEN u.n = 1 THEN tail END) AS target FROM c LEFT JOIN d ON d.module = c.module AND d.raw = c.raw LEFT JOIN u ON u.module = c.module AND u.raw = c.raw")
def import_resolve(spark, sf):
    p = read(spark, sf, "part")
    brand, size = F.replace(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("Brand"), F.lit("b")), F.col("p_size").cast("string")
    ids = p.select(F.concat(F.lit("pkg."), brand, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(".m"), size)).otherwise("")).alias("id")).distinct()
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("pkg."), brand, F.lit(".m"), size, F.lit(".deep"))).when(k == 1, F.concat(F.lit("m"), size, F.lit(".h"))).when(k == 2, F.concat(F.lit("."), brand, F.lit("/m"), size)).otherwise("other.thing")
    return index.resolve_imports(p.select(F.concat(F.lit("x"), (F.col("p_partkey") % 50).cast("string")).alias("module"), raw.alias("raw")).distinct(), ids)


@query(with_("g_edges") + """, r(id) AS (SELECT unnest(['region:1', 'nation:7']) UNION SELECT target FROM g_edges JOIN r ON source = r.id WHERE type = 'contains') SELECT id FROM r""")
def tombstone_closure(spark, sf):
    return reconcile.tombstone_closure(project(spark, sf, "g_edges"), spark.createDataFrame([("region:1",), ("nation:7",)], "id string"))


@query(with_("g_nodes") + """SELECT id, CASE WHEN lost THEN 'stale' ELSE status END AS status, lost AS stale_now FROM (SELECT *, type IN ('code_module', 'implementation_symbol') AND source = 'code' AND ord % 3 = 0 AS lost FROM g_nodes)""")
def stale_mark(spark, sf):
    n = project(spark, sf, "g_nodes")
    return reconcile.mark_stale(n, n.where("ord % 3 <> 0")).select("id", "status", "stale_now")


@query(with_("g_nodes") + """, k AS (SELECT * FROM g_nodes WHERE ord % 4 <> 0), f AS (SELECT id, type, 'new/' || path AS path FROM g_nodes WHERE ord % 5 <> 0 AND path IS NOT NULL)
SELECT coalesce(k.id, f.id) AS id, coalesce(k.type, f.type) AS type, coalesce(f.path, k.path) AS path, CASE WHEN k.id IS NULL OR (f.id IS NOT NULL AND status = 'stale') THEN 'active' ELSE status END AS status, k.id IS NULL AS created FROM k FULL JOIN f ON k.id = f.id""")
def upsert_nodes(spark, sf):
    n = project(spark, sf, "g_nodes")
    return reconcile.upsert_nodes(n.where("ord % 4 <> 0"), n.where("ord % 5 <> 0 and path is not null").select("id", "type", F.concat(F.lit("new/"), "path").alias("path")))


@query(with_("g_edges") + """, f AS (SELECT DISTINCT source, target, type FROM g_edges WHERE ord % 3 = 0 UNION SELECT source, target, 'calls' FROM g_edges WHERE ord % 100 = 1),
k AS (SELECT * FROM g_edges e WHERE mode <> 'AUTO' OR ord % 2 = 0 OR EXISTS (SELECT 1 FROM f WHERE f.source = e.source AND f.target = e.target AND f.type = e.type))
SELECT source, target, type, mode, 'kept' AS origin FROM k UNION ALL SELECT source, target, type, 'AUTO', 'new' FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE f.source = k.source AND f.target = k.target AND f.type = k.type)""")
def edge_refresh(spark, sf):
    e = project(spark, sf, "g_edges").withColumn("made_by", F.when(F.col("ord") % 2 == 1, "implementation-analyzer"))
    found = e.where("ord % 3 = 0").select("source", "target", "type").unionByName(e.where("ord % 100 = 1").select("source", "target", F.lit("calls").alias("type")))
    return reconcile.refresh_edges(e, found)


_IMPORTED = """im AS (SELECT DISTINCT "from" AS source, "to" AS target FROM g_facts WHERE type = 'IMPORT' AND "to" LIKE 'supplier:%')"""


@query(with_("g_facts", "g_edges") + f", {_IMPORTED} SELECT source, target FROM im WHERE source <> target AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.source = im.source AND e.target = im.target)")
def suggest_missing(spark, sf):
    return reconcile.suggest_missing(_imports(spark, sf), project(spark, sf, "g_edges"))


def _imports(spark, sf):
    return project(spark, sf, "g_facts").where("type = 'IMPORT' and `to` like 'supplier:%'").select(F.col("from").alias("source"), F.col("to").alias("target"))


@query(with_("g_facts", "g_edges", "g_nodes") + f", {_IMPORTED} SELECT source, target, type FROM g_edges e WHERE mode = 'AUTO' AND type IN ('dependency', 'interface', 'depends_on') AND source IN (SELECT id FROM g_nodes WHERE path IS NOT NULL) AND target IN (SELECT id FROM g_nodes WHERE path IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM im WHERE e.source = im.source AND e.target = im.target)")
def suggest_stale(spark, sf):
    return reconcile.suggest_stale(_imports(spark, sf), project(spark, sf, "g_edges"), project(spark, sf, "g_nodes").where("path is not null"))


@query(with_("g_nodes", "g_items") + """, hit AS (SELECT DISTINCT functional, mode FROM g_items WHERE ord % 9 = 1)
SELECT id, CASE WHEN mode = 'MANUAL' THEN status ELSE 'stale' END AS status, CASE WHEN mode = 'MANUAL' THEN 'review_required' ELSE 'stale' END AS invalidation FROM g_nodes WHERE type = 'functional' AND id IN (SELECT functional FROM hit)""")
def invalidate(spark, sf):
    n = project(spark, sf, "g_nodes").withColumns({"module": F.lit(None).cast("string"), "qualified_id": F.lit(None).cast("string")})
    items = project(spark, sf, "g_items")
    changed = items.where("ord % 9 = 1").select(F.lit("symbol").alias("kind"), F.col("impl_id").alias("id"))
    return reconcile.invalidate(n, items, changed)[1]


@query(with_("g_nodes", "g_edges") + "SELECT source AS id, arg_min(target, ord) AS parent FROM g_edges WHERE source LIKE 'customer:%' AND target LIKE 'supplier:%' AND source IN (SELECT id FROM g_nodes) AND target IN (SELECT id FROM g_nodes) GROUP BY 1")
def hierarchy_by_edges(spark, sf):
    e = project(spark, sf, "g_edges").where("source like 'customer:%' and target like 'supplier:%'")
    inside = e.select("ord", F.col("target").alias("source"), F.col("source").alias("target"), F.lit("contains").alias("type"))
    return views.hierarchy_parents(project(spark, sf, "g_nodes"), inside)


@query("""WITH n AS (SELECT p_partkey AS ord, p_brand || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ':C' || CAST(p_size % 7 AS VARCHAR) ELSE ':C' || CAST(p_size % 7 AS VARCHAR) || '.f' || CAST(p_partkey AS VARCHAR) END AS id, p_size % 4 AS lv FROM part),
d AS (SELECT id, min(lv) AS lv FROM n GROUP BY id),
c AS (SELECT a.id AS id, b.id AS parent, length(b.id) AS l FROM d a JOIN d b ON b.lv < a.lv AND (starts_with(a.id, b.id || '.') OR starts_with(a.id, b.id || ':') OR starts_with(a.id, b.id || '#')) WHERE a.lv > 0)
SELECT id, max_by(parent, l) AS parent FROM c GROUP BY id""")
def hierarchy_parent(spark, sf):
    p = read(spark, sf, "part")
    cls = F.concat(F.lit(":C"), (F.col("p_size") % 7).cast("string"))
    lv = F.col("p_size") % 4
    n = p.select(F.concat("p_brand", F.when(lv == 0, "").when(lv == 1, cls).otherwise(F.concat(cls, F.lit(".f"), F.col("p_partkey").cast("string")))).alias("id"), lv.alias("lv")).groupBy("id").agg(F.min("lv").alias("lv"))
    kinds = F.array(*[F.lit(k) for k in ("code_module", "implementation_class", "implementation_function", "implementation_symbol")])
    nodes = n.select(F.lit(0).alias("ord"), "id", F.element_at(kinds, F.col("lv") + 1).alias("type"), F.lit("").alias("path"))
    return views.hierarchy_parents(nodes, spark.createDataFrame([], "ord bigint, source string, target string, type string"))


@query(with_("g_edges") + """, r(id, depth) AS (SELECT target, 1 FROM g_edges WHERE type = 'contains' AND source = 'region:2' UNION SELECT target, depth + 1 FROM g_edges JOIN r ON source = r.id WHERE type = 'contains') SELECT id, depth FROM r""")
def descendants(spark, sf):
    return views.descendants(project(spark, sf, "g_nodes"), project(spark, sf, "g_edges"), spark.createDataFrame([("region:2",)], "id string"))


@query(with_("g_nodes", "g_edges") + """, e AS (SELECT source, target FROM g_edges WHERE type = 'contains'), r(id, level) AS (SELECT id, 0 FROM g_nodes WHERE id NOT IN (SELECT target FROM e) UNION SELECT target, level + 1 FROM e JOIN r ON source = r.id) SELECT id, min(level) AS level FROM r GROUP BY id""")
def layer_levels(spark, sf):
    return views.layer_levels(project(spark, sf, "g_nodes"), project(spark, sf, "g_edges").where("type = 'contains'"))


@query(with_("g_nodes") + "SELECT id FROM g_nodes WHERE type NOT IN ('code_module', 'implementation_symbol') AND contains(lower(id || ' ' || title), 'nation_1')")
def view_filter(spark, sf):
    return views.view_filter(project(spark, sf, "g_nodes"), project(spark, sf, "g_edges"), "semantic", "NATION_1")


@query(with_("g_nodes", "g_edges", "g_items") + """, v AS (SELECT id FROM g_nodes WHERE type <> 'implementation_symbol'), a AS (SELECT source, target, type FROM g_edges UNION ALL SELECT functional, impl_id, 'implemented_by' FROM g_items)
SELECT * FROM a WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)""")
def display_edges(spark, sf):
    return views.display_edges(project(spark, sf, "g_edges"), project(spark, sf, "g_items"), project(spark, sf, "g_nodes").where("type <> 'implementation_symbol'"))


@query("SELECT CAST(min(80 + (p_partkey % 4) * 260) AS DOUBLE) AS min_x, CAST(max(80 + (p_partkey % 4) * 260) AS DOUBLE) AS max_x, CAST(min(80 + floor(p_partkey / 4) * 180) AS DOUBLE) AS min_y, CAST(max(80 + floor(p_partkey / 4) * 180) AS DOUBLE) AS max_y FROM part")
def bbox(spark, sf):
    from ..operators.store import placed_by_index

    return views.bounding_box(placed_by_index(read(spark, sf, "part").select(F.col("p_partkey").alias("ord"))))

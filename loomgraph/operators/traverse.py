"""Bounded semantic traversal and what follows it (survey rows K13-K20, K25, 2.14).

Traversal goes level by level (three levels at most), each level two joins of the frontier with the edges. The first-in
first-out order of visits is kept as ``pos``: a node's rank in its level is the least ``(parent's pos, edge's ord)`` that
reached it, so results equal those of a queue. Forced exclusions that edges make on the way act from their own place on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import filled, rendered_detail, term_hits, trim_all
from .closure import reach, settle, small_side
from .store import is_implementation

NARROWED = "task-relevant symbol in "
FORCED_SCOPE = "content,code,interface,contract,state,decisions"


def depth_limits(entry_is_task: bool, policy: dict, semantic_depth: int = 3) -> dict[str, int]:
    """Limits of depth for nodes at large, interfaces and tests; a task as entry adds one."""
    bounded = lambda v, other: max(0, min(3, v)) if isinstance(v, int) else other
    configured, offset = max(1, min(3, semantic_depth)), int(entry_is_task)
    semantic = min(configured, offset + bounded(policy["functionalDependencies"]["depth"], configured))
    inner = semantic - offset
    return {"semantic": semantic, "interface": offset + bounded(policy["interfaces"]["depth"], inner), "test": offset + bounded(policy["tests"]["depth"], inner)}


def traverse(nodes: DataFrame, edges: DataFrame, items: DataFrame, entry: str, limits: dict[str, int], force_exclude: DataFrame, force_include: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``selected`` (id, depth, reason, scope, pos), ``excluded`` and ``included`` ids after the walk from ``entry``."""
    one = nodes.sparkSession.createDataFrame([(0, entry, limits["semantic"], limits["interface"], limits["test"])], "walk int, entry string, semantic int, interface int, test int")
    named = lambda df: df.select(F.lit(0).alias("walk"), "id")
    return tuple(df.drop("walk") for df in walks(nodes, edges, items, one, named(force_exclude), named(force_include), limits["semantic"]))


def walks(nodes: DataFrame, edges: DataFrame, items: DataFrame, entries: DataFrame, force_exclude: DataFrame, force_include: DataFrame, levels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K14 for many entries at once: ``selected`` (walk, id, depth, reason, scope, pos), ``excluded`` and ``included`` (walk, id).

    entries: ``walk, entry, semantic, interface, test`` (limits of depth, ``levels`` at most); force_exclude, force_include: ``walk, id``.
    nodes: ``id, type``; edges: ``ord, source, target, type, mode, scope`` (joined by commas); items: ``functional, impl_id, ord``.
    All walks take their levels together: the jobs are as many as the levels, whatever the number of walks.
    """
    kinds = nodes.select("id", "type")
    excluded, included = force_exclude.select("walk", "id").distinct(), force_include.select("walk", "id").distinct()
    selected = entries.join(kinds.select(F.col("id").alias("entry")), "entry").select("walk", F.col("entry").alias("id"), F.lit(0).alias("depth"), F.lit("context entry").alias("reason"), F.lit("content,code,context,interface,contract").alias("scope"), F.lit(0).cast("bigint").alias("pos"), F.lit(True).alias("expand"))
    # a walk goes on from these only: edges that no such node has are not looked at
    goes_on = kinds.where("type in ('functional', 'task')").select(F.col("id").alias("here")).unionByName(entries.select(F.col("entry").alias("here")))
    targets = edges.where("type = 'targets'")
    goes_on = small_side(goes_on.unionByName(targets.select(F.col("source").alias("here"))).unionByName(targets.select(F.col("target").alias("here"))).distinct())
    both = edges.select("ord", F.col("source").alias("here"), F.col("target").alias("next"), F.lit(True).alias("forward"), "type", "mode", "scope").join(goes_on, "here", "left_semi").unionByName(
        edges.where("source <> target").select("ord", F.col("target").alias("here"), F.col("source").alias("next"), F.lit(False).alias("forward"), "type", "mode", "scope").join(goes_on, "here", "left_semi")
    )
    both = both.where("type <> 'derived_from'").where(F.col("forward") | ~F.col("type").isin(schema.FORWARD_TYPES))
    ends = small_side(kinds.join(goes_on, F.col("id") == F.col("here"), "left_semi").select(F.col("id").alias("here"), F.col("type").alias("here_type")))
    both = both.join(ends, "here").join(kinds.select(F.col("id").alias("next"), F.col("type").alias("next_type")), "next")
    # from a function to code an edge matters only if it forces something
    forces = F.coalesce(F.col("forward") & (F.col("mode").isin("FORCE_EXCLUDE", "FORCE_INCLUDE") | F.col("type").isin("force_exclude", "force_include")), F.lit(False))
    both = both.where(forces | ~((F.col("here_type") == "functional") & is_implementation(F.col("next_type"))))
    both = settle(both.where(~(F.col("type").isin(schema.CODE_EDGE_TYPES) & (F.col("here_type") == "functional"))))
    owners = items.select("functional", F.col("impl_id").alias("next"), F.col("ord").alias("item_ord")).join(kinds.where("type = 'functional'").select(F.col("id").alias("functional")), "functional")
    code = lambda c: is_implementation(F.col(c))
    at = F.struct(F.col("pos").alias("p"), F.col("ord").alias("o"))
    out_of = lambda df, name: df.withColumnRenamed("id", name)
    for depth in range(1, levels + 1):
        # nodes of the last level that may expand, in order of visit; those excluded before their turn do not
        frontier = selected.where(F.col("expand") & (F.col("depth") == depth - 1)).select("walk", F.col("id").alias("here"), "pos").join(entries.where(F.col("semantic") >= depth), "walk")
        step = frontier.join(out_of(excluded, "here"), ["walk", "here"], "left_anti").join(both, "here").withColumn("at", at)
        near = ((F.col("next_type") == "interface") | (F.col("type") == "interface")) & (F.col("interface") < depth)
        near |= ((F.col("next_type") == "test") | (F.col("type") == "tests")) & (F.col("test") < depth)
        near |= (F.col("next_type") == "task") & (F.col("next") != F.col("entry"))
        out_edge = F.coalesce(F.col("forward") & ((F.col("mode") == "FORCE_EXCLUDE") | (F.col("type") == "force_exclude")), F.lit(False))
        step = step.where(~near).join(out_of(excluded, "next"), ["walk", "next"], "left_anti").withColumn("out_edge", out_edge)
        step = settle(step.drop("entry", "semantic", "interface", "test"))
        stops = _exclusions(step.where("out_edge").select("walk", "here", "pos", "next", "at"))
        # what is excluded at a place is gone for all later ones
        gone = lambda name: stops.select("walk", F.col("next").alias(name), F.col("at").alias(f"{name}_gone"))  # noqa: B023, E731
        step = step.where("not out_edge").join(gone("next"), ["walk", "next"], "left").where(F.col("next_gone").isNull() | (F.col("at") < F.col("next_gone")))
        step = step.join(gone("here"), ["walk", "here"], "left").where(F.col("here_gone").isNull() | (F.col("here_gone.p") >= F.col("pos")))
        in_edge = F.coalesce(F.col("forward") & ((F.col("mode") == "FORCE_INCLUDE") | (F.col("type") == "force_include")), F.lit(False))
        forced = step.where(in_edge).select("walk", F.col("next").alias("id"))
        step = step.where(~in_edge & (F.col("here_type").isin("task", "functional") | code("here_type")))
        to_code = (F.col("type") == "targets") & (F.col("here_type") == "task") & code("next_type")
        through = step.where(to_code).join(owners, "next").join(out_of(excluded, "functional"), ["walk", "functional"], "left_anti").join(gone("functional"), ["walk", "functional"], "left")
        through = through.where(F.col("functional_gone").isNull() | (F.col("at") < F.col("functional_gone")))
        direct = step.join(through.select("walk", "ord", "next", "pos").distinct(), ["walk", "ord", "next", "pos"], "left_anti").where(~((F.col("here_type") == "functional") & code("next_type")))
        expand = F.col("next_type").isin("functional", "task") | ((F.col("type") == "targets") & code("next_type"))
        said = F.concat_ws(" ", F.col("type"), F.when(F.col("forward"), "from").otherwise("to"), F.col("here"))
        found = direct.select("walk", F.col("next").alias("id"), F.struct("at", F.lit(0).cast("bigint").alias("k")).alias("at"), F.struct(said.alias("reason"), F.coalesce("scope", F.lit("")).alias("scope"), expand.alias("expand")).alias("v"))
        mapped = through.select("walk", F.col("functional").alias("id"), F.struct("at", F.col("item_ord").cast("bigint").alias("k")).alias("at"), F.struct(F.concat(F.lit("functional mapping for task target "), F.col("next")).alias("reason"), F.lit("content,interface,contract").alias("scope"), F.lit(True).alias("expand")).alias("v"))
        first = found.unionByName(mapped).groupBy("walk", "id").agg(F.min_by("v", "at").alias("v"), F.min("at").alias("at")).join(selected.select("walk", "id"), ["walk", "id"], "left_anti")
        # a window holds what one walk reaches in a level
        first = first.withColumn("pos", F.row_number().over(Window.partitionBy("walk").orderBy("at")).cast("bigint") + depth * (1 << 32))
        level = first.select("walk", "id", F.lit("s").alias("kind"), F.lit(depth).alias("depth"), "v.reason", "v.scope", "pos", "v.expand")
        bare = lambda df, kind: df.select("walk", "id", F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("depth"), *[F.lit(None).cast(t).alias(c) for c, t in (("reason", "string"), ("scope", "string"), ("pos", "bigint"), ("expand", "boolean"))])
        level = settle(level.unionByName(bare(stops.select("walk", F.col("next").alias("id")), "x")).unionByName(bare(forced.distinct(), "i")))
        late = level.where("kind = 'x'").select("walk", "id")
        selected = selected.unionByName(level.where("kind = 's'").drop("kind")).join(late, ["walk", "id"], "left_anti")
        excluded = excluded.unionByName(late).distinct()
        included = included.unionByName(level.where("kind = 'i'").select("walk", "id")).distinct().join(late, ["walk", "id"], "left_anti")
    return selected.drop("expand"), excluded, included


def _exclusions(step: DataFrame) -> DataFrame:
    """Edges that exclude, less those of nodes which an earlier one excluded. Their order matters only along chains in a level."""
    first = step.groupBy("walk", "next").agg(F.min("at").alias("at"))
    alive = step.join(first.select("walk", F.col("next").alias("here"), F.col("at").alias("dead")), ["walk", "here"], "left").where(F.col("dead").isNull() | (F.col("dead.p") >= F.col("pos")))
    return alive.groupBy("walk", "next").agg(F.min("at").alias("at"))


def selected_functions(selected: DataFrame, nodes: DataFrame, entry: str | Column) -> DataFrame:
    """Functional nodes whose implementation counts: the entry, those with the code scope, targets and mapped ones."""
    ok = (F.col("id") == entry) | F.array_contains(F.split("scope", ","), "code") | F.startswith("reason", F.lit("targets ")) | F.startswith("reason", F.lit("functional mapping for task target "))
    return selected.where(ok).join(nodes.where("type = 'functional'").select("id"), "id", "left_semi")


def mapping_overrides(functions: DataFrame, items: DataFrame, excluded: DataFrame, included: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Excluded and included ids after forced mappings of the functions; an exclusion wins over any inclusion. ``by``: columns of the walk."""
    mine = items.join(functions.select(*by, F.col("id").alias("functional")), "functional")
    forced = lambda mode: mine.where(F.col("mode") == mode).select(*by, F.col("impl_id").alias("id"))
    out = excluded.select(*by, "id").unionByName(forced("FORCE_EXCLUDE")).distinct()
    into = included.select(*by, "id").unionByName(forced("FORCE_INCLUDE")).distinct()
    return out, into.join(out, [*by, "id"], "left_anti")


def contained(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``file, id``: all that a file contains, however deep."""
    step, found, level = edges.where("type = 'contains'").select(F.col("source").alias("id"), F.col("target").alias("child")), None, small_side(files.select(F.col("id").alias("file"), "id").distinct())
    while True:
        level = level.join(step, "id").select("file", F.col("child").alias("id")).where("file <> id").distinct()
        level = settle(level if found is None else level.join(found, ["file", "id"], "left_anti"))
        if level.isEmpty():
            return level if found is None else found
        found = level if found is None else found.unionByName(level)


def symbol_hits(inside: DataFrame, nodes: DataFrame, terms: Column, most: int = 3, by: tuple[str, ...] = (), asks: DataFrame | None = None) -> DataFrame:
    """``file, symbol, hits, rank``: of a file's symbols (``file, id``) those that task terms hit, the best three by hits, then id.

    asks: ``file`` and the columns that ``by`` and ``terms`` have, where a file is asked for several times.
    """
    text = F.concat_ws(" ", "id", F.coalesce("title", F.lit("")), F.coalesce("label", F.lit("")), F.coalesce("signature", F.lit("")))
    symbols = inside.join(nodes.select("id", text.alias("said")), "id")
    symbols = symbols if asks is None else symbols.join(small_side(asks), "file")
    scored = symbols.withColumn("hits", term_hits(F.col("said"), terms)).where("hits > 0").select(*by, "file", "id", "hits")
    rank = F.row_number().over(Window.partitionBy(*by, "file").orderBy(F.desc("hits"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(*by, "file", F.col("id").alias("symbol"), "hits", "rank")


def symbol_narrowing(files: DataFrame, nodes: DataFrame, edges: DataFrame, terms: Column, most: int = 3) -> DataFrame:
    """K17 for one task: ``file, symbol, hits, rank``."""
    return symbol_hits(contained(files, edges), nodes, terms, most)


def candidate_priority(node_priority: Column, depth: Column, entry_code: Column) -> Column:
    """A candidate's priority by its node's, else by its depth; the entry's code comes a little before."""
    base = F.when(node_priority == "critical", 940).when(node_priority == "high", 900).when(depth == 0, 880).otherwise(680 - depth * 40)
    return base + F.when(entry_code, 30).otherwise(0)


def candidate_rows(chosen: DataFrame, nodes: DataFrame, memory: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates, and nodes left out with a reason (request, id, reason), of what was chosen for each request.

    chosen: ``request, entry, task, id, depth, reason, scope, pos``; nodes: as normalised, with ``raw`` and ``code`` (the text of the
    node's lines, if it has any); memory: ``module, scope, text``, what is kept of a module beside its code.
    """
    rows = chosen.join(nodes, "id")
    forced_in = F.col("reason") == "FORCE_INCLUDE"
    code = is_implementation(F.col("type"))
    raw = (F.col("type") == "conversation") | F.coalesce(F.col("raw"), F.lit(False))
    why = F.when((F.col("status") != "active") & ~forced_in, F.col("status")).when(raw & ~forced_in, "raw context disabled by policy")
    rows = rows.withColumn("why", why)
    is_entry = F.col("id") == F.col("entry")
    target = (F.col("type") == "functional") & (is_entry | F.col("reason").rlike("^(targets |functional mapping for task target )"))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    repeats = is_entry & (F.col("type") == "task") & (F.col("content") != "") & F.contains(squeeze(F.col("task")), squeeze(F.col("content")))
    none = F.array().cast("array<string>")
    col = lambda name: F.coalesce(F.col(name), none) if name in nodes.columns else none
    detail = rendered_detail(filled(F.col("description"), F.col("content"), F.lit("")), col("provides"), col("consumes"), col("inputs"), col("outputs"))
    text = F.when(F.col("type") == "functional", detail).otherwise(F.when(~repeats, F.col("content")))
    scope = F.when(code, "content").when(F.col("type") == "test", "test").when(F.col("type") == "interface", "interface").otherwise("content")
    live = rows.where("why is null")
    base = ["request", F.col("id").alias("node"), F.col("type").alias("node_type"), "status", F.col("priority").alias("priority_name"), "depth", "reason", "pos"]
    forced = (forced_in | (F.col("mode") == "FORCE_INCLUDE")).alias("force_include")
    own = live.select(*base, F.concat(F.col("title"), F.lit(" ("), F.col("type"), F.lit(")")).alias("label"), text.alias("content"), scope.alias("scope"), candidate_priority(F.col("priority"), F.col("depth"), F.lit(False)).alias("p"), ((is_entry & (F.col("type") != "functional")) | target).alias("required"), forced)
    wanted = F.split(F.when(F.col("scope") != "", F.col("scope")).when(is_entry, "code,context,interface,state,decisions").otherwise("interface,contract"), ",")
    parts = live.where(code).withColumn("part", F.explode(F.array_distinct(wanted))).where("part not in ('content', 'contract')")
    kept = parts.where("part = 'code'").withColumn("said", F.col("code"))
    if memory is not None:
        kept = kept.unionByName(parts.where("part <> 'code'").join(memory.select(F.col("module").alias("id"), F.col("scope").alias("part"), F.col("text").alias("said")), ["id", "part"]), allowMissingColumns=True)
    parts = kept.select(*base, F.concat(F.col("title"), F.lit(" "), F.col("part")).alias("label"), F.col("said").alias("content"), F.col("part").alias("scope"), candidate_priority(F.col("priority"), F.col("depth"), is_entry & (F.col("part") == "code")).alias("p"), F.lit(False).alias("required"), forced)
    out = own.unionByName(parts).where(trim_all(F.col("content")) != "").withColumnRenamed("p", "priority")
    narrowed = chosen.where(F.startswith("reason", F.lit(NARROWED))).select("request", F.expr(f"substring(reason, {len(NARROWED) + 1})").alias("id"), F.lit(True).alias("narrowed")).distinct()
    empty = live.where(~repeats).select("request", "id").join(out.select("request", F.col("node").alias("id")), ["request", "id"], "left_anti").join(narrowed, ["request", "id"], "left")
    empty = empty.select("request", "id", F.when(F.col("narrowed"), "resolved to symbol-level implementation").otherwise("selected context source is empty").alias("reason"))
    return out, rows.where("why is not null").select("request", "id", F.col("why").alias("reason")).unionByName(empty)


def candidates(selected: DataFrame, nodes: DataFrame, excluded: DataFrame, included: DataFrame, entry: str, task: str) -> tuple[DataFrame, DataFrame]:
    """K18-K20, K25 for one entry: candidates, and every node left out with a reason."""
    into = included.join(excluded, "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
    forced = into.select("id", F.lit(0).alias("depth"), F.lit("FORCE_INCLUDE").alias("reason"), F.lit(FORCED_SCOPE).alias("scope"), F.lit(1 << 40).cast("bigint").alias("pos"))
    chosen = selected.select("id", "depth", "reason", "scope", "pos").join(into, "id", "left_anti").unionByName(forced)
    rows = chosen.join(excluded, "id", "left_anti").withColumns({"request": F.lit(entry), "entry": F.lit(entry), "task": F.lit(task)})
    out, left = candidate_rows(rows, nodes)
    left = left.drop("request").unionByName(excluded.join(nodes.select("id"), "id", "left_semi").select("id", F.lit("FORCE_EXCLUDE").alias("reason")))
    raw = (F.col("type") == "conversation") | F.coalesce(F.col("raw"), F.lit(False))
    rest = nodes.join(chosen.select("id"), "id", "left_anti").join(excluded, "id", "left_anti")
    left = left.unionByName(rest.select("id", F.when(raw, "raw context disabled by policy").otherwise("not selected by semantic traversal").alias("reason")))
    return out, left


def compile_context(nodes: DataFrame, edges: DataFrame, items: DataFrame, entry: str, task: str, budget: int, force_exclude: DataFrame, force_include: DataFrame, policy: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Traversal, mapping overrides, implementation choice, candidates and selection for one task. Returns the selection
    (columns of ``select_by_budget``) and the nodes left out before it."""
    from ..functions.text import task_terms
    from .infer import pick_implementations
    from .policy import resolve_policy, select_by_budget

    policy = resolve_policy(policy)
    kind = nodes.where(F.col("id") == entry).select("type").first()
    if kind is None:
        raise ValueError(f"unknown context entry: {entry}")
    limits = depth_limits(kind.type == "task", policy)
    by_mode = lambda m: nodes.where(F.col("mode") == m).select("id")
    selected, excluded, included = traverse(nodes, edges, items, entry, limits, force_exclude.select("id").unionByName(by_mode("FORCE_EXCLUDE")), force_include.select("id").unionByName(by_mode("FORCE_INCLUDE")))
    selected = settle(selected)
    functions = settle(selected_functions(selected, nodes, entry))
    excluded, included = (settle(df) for df in mapping_overrides(functions, items, excluded, included))
    if policy["implementation"]["depth"]:
        most = max(0, min(5, policy["implementation"].get("maxFiles", 3)))
        mine = items.join(functions.select(F.col("id").alias("functional"), "depth", "pos"), "functional")
        best = pick_implementations(mine, task_terms(F.lit(task), "functional"), most)
        chosen = best.join(functions.select(F.col("id").alias("functional"), "depth", "pos"), "functional").join(nodes.select(F.col("id").alias("impl_id")), "impl_id", "left_semi")
        first = chosen.groupBy(F.col("impl_id").alias("id")).agg(F.min(F.struct("pos", "rank", "depth", "functional")).alias("f"))
        first = first.join(selected, "id", "left_anti").join(excluded, "id", "left_anti")
        depth = policy["implementation"]["depth"]
        selected = selected.unionByName(first.select("id", (F.col("f.depth") + depth).alias("depth"), F.concat(F.lit("implemented_by "), F.col("f.functional")).alias("reason"), F.lit("code,interface").alias("scope"), (F.col("f.pos") * 8 + F.col("f.rank") + (1 << 36)).alias("pos")))
    found, left = candidates(settle(selected), nodes, excluded, included, entry, task)
    spark = nodes.sparkSession
    first_row = spark.createDataFrame([(entry, kind.type, "active", None, 0, "current request", -1, "User task", task, "task", 1000, True, False)], "node string, node_type string, status string, priority_name string, depth int, reason string, pos bigint, label string, content string, scope string, priority int, required boolean, force_include boolean")
    rows = found.drop("request").unionByName(first_row) if task.strip() else found.drop("request")
    place = F.row_number().over(Window.partitionBy("request").orderBy("pos", "node", "scope")).cast("bigint")
    rows = rows.withColumn("request", F.lit(entry)).withColumns({"ord": place, "raw": F.lit(False), "raw_kind": F.lit(None).cast("string")}).drop("pos")
    return select_by_budget(rows, budget, policy), left


__all__ = ["candidate_priority", "candidate_rows", "candidates", "compile_context", "contained", "depth_limits", "mapping_overrides", "reach", "selected_functions", "symbol_hits", "symbol_narrowing", "traverse", "walks"]

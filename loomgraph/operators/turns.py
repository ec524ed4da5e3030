"""Compile of user turns (survey row K26): from messages to a selection, for all sessions in one plan.

What a session cannot get is a row with a code, not an exception. Walks depend on a target, limits and forced nodes only, so sessions
that agree in these share one; what depends on a task's words (items, symbols, candidates, budget) is joined to them afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import task_terms
from .closure import settle, small_side
from .infer import pick_implementations
from .policy import resolve_policy, select_by_budget
from .session import DEFAULTS, LIMITS
from .target import alias_table, infer_target, latest_user_text, named_exclusions
from .traverse import FORCED_SCOPE, NARROWED, candidate_rows, contained, mapping_overrides, selected_functions, symbol_hits, walks

# Why a turn gets no selection; the last one is the user's to settle, after the others the turn goes on without context.
EMPTY, NO_TARGET, AMBIGUOUS = "GRAPH_EMPTY", "TARGET_REQUIRED", "EXCLUSION_AMBIGUOUS"


def turn_settings(tasks: DataFrame, settings: DataFrame | None) -> DataFrame:
    """Tasks (``session, text``) with their settings: the session's own, held in range, else the defaults."""
    names = {"target": "string", "tokenBudget": "int", "maxImplementationFiles": "int", "semanticDepth": "int", "include": "array<string>", "exclude": "array<string>"}
    given = settings.columns if settings is not None else []
    out = tasks.join(settings.select("session", *[c for c in names if c in given]), "session", "left") if settings is not None else tasks
    own = {c: F.col(c).cast(t) if c in given else F.lit(None).cast(t) for c, t in names.items()}

    def held(name: str) -> Column:
        low, high = LIMITS[name]
        value = F.greatest(F.coalesce(own[name], F.lit(DEFAULTS[name])), F.lit(low))
        return F.least(value, F.lit(high)) if high else value

    none = F.array().cast("array<string>")
    return out.select("session", "text", F.nullif(own["target"], F.lit("")).alias("target"), held("tokenBudget").alias("token_budget"), held("maxImplementationFiles").alias("max_files"), held("semanticDepth").alias("depth"), F.coalesce(own["include"], none).alias("include"), F.coalesce(own["exclude"], none).alias("exclude"))


def turn_targets(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """Turns with ``exclude`` completed by what their texts exclude, the ``target`` they get, and ``code, aliases`` where they get none.

    ``aliases``: names that may mean several nodes.
    """
    tasks = turns.select(F.col("session").alias("task_id"), "text")
    names = alias_table(nodes)
    named = settle(named_exclusions(tasks, names))
    unclear = named.where("id IS NULL").groupBy(F.col("task_id").alias("session")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    clear = named.where("id IS NOT NULL").groupBy(F.col("task_id").alias("session")).agg(F.collect_set("id").alias("named"))
    turns = turns.join(clear, "session", "left").join(unclear, "session", "left")
    turns = settle(turns.withColumn("exclude", F.array_sort(F.array_distinct(F.concat("exclude", F.coalesce("named", F.array().cast("array<string>")))))).drop("named"))
    stated = turns.where("target IS NOT NULL").select("session", F.col("target").alias("id")).join(nodes.select("id"), "id", "left_semi").select("session", F.col("id").alias("stated"))
    blocked = turns.select(F.col("session").alias("task_id"), F.explode("exclude").alias("id"))
    told = infer_target(turns.where("aliases IS NULL").select(F.col("session").alias("task_id"), "text"), nodes, blocked).select(F.col("task_id").alias("session"), F.col("target").alias("told"))
    turns = turns.join(stated, "session", "left").join(told, "session", "left").withColumn("target", F.coalesce("stated", "told"))
    code = F.when(F.col("aliases").isNotNull(), AMBIGUOUS).when(F.col("target").isNull(), NO_TARGET)
    return settle(turns.withColumn("code", code).drop("stated", "told"))


def turn_verdicts(messages: DataFrame, nodes: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """``session, code, fallback, target, token_budget, force_exclude, aliases, options, n_options`` of the last user message of every session, as
    ``compile_turns`` has them."""
    turns = turn_settings(latest_user_text(messages), settings)
    return _verdicts(_without_graph(turns) if nodes.isEmpty() else turn_targets(turns, nodes), nodes)


def _without_graph(turns: DataFrame) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return turns.withColumns({"target": F.lit(None).cast("string"), "code": F.lit(EMPTY), "aliases": none})


def _verdicts(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """``options``, the nodes that unclear names may mean, are found once for all sessions that have the same unclear names."""
    lists = turns.where("aliases IS NOT NULL").select("aliases").distinct()
    means = lists.withColumn("alias", F.explode("aliases")).join(alias_table(nodes), "alias")
    turns = turns.join(means.groupBy("aliases").agg(F.array_sort(F.collect_set("id")).alias("options"), F.count_distinct("id").alias("n_options")), "aliases", "left")
    blank = F.array().cast("array<string>")
    fallback = F.coalesce(F.col("code").isin(EMPTY, NO_TARGET), F.lit(False))
    target = F.when(F.col("code").isNull(), F.col("target"))
    return turns.select("session", "code", fallback.alias("fallback"), target.alias("target"), "token_budget", F.col("exclude").alias("force_exclude"), F.coalesce("aliases", blank).alias("aliases"), F.coalesce("options", blank).alias("options"), F.coalesce("n_options", F.lit(0)).cast("bigint").alias("n_options"))


def limits_of(policy: dict, is_task: Column, depth: Column) -> dict[str, Column]:
    """Limits of depth as columns: nodes at large, interfaces, tests; a task as entry adds one."""
    offset = is_task.cast("int")

    def bounded(value, other: Column) -> Column:
        return F.lit(max(0, min(3, value))) if isinstance(value, int) else other

    configured = F.greatest(F.lit(1), F.least(F.lit(3), depth))
    semantic = F.least(configured, offset + bounded(policy["functionalDependencies"]["depth"], configured))
    return {"semantic": semantic, "interface": offset + bounded(policy["interfaces"]["depth"], semantic - offset), "test": offset + bounded(policy["tests"]["depth"], semantic - offset)}


def compile_turns(messages: DataFrame, nodes: DataFrame, edges: DataFrame, items: DataFrame, settings: DataFrame | None = None, policy: dict | None = None, rules: str = "", memory: DataFrame | None = None, scan: Callable[[], tuple[DataFrame, DataFrame, DataFrame]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``verdicts``, ``selection`` and ``left`` for the last user message of every session.

    verdicts: ``session, code, fallback, target, token_budget, force_exclude, aliases, options, n_options``; a null code is a compiled turn, ``fallback``
    says that the turn goes on without context. selection: columns of ``select_by_budget``, ``request`` being the session. left: ``request,
    id, reason`` of what the walk chose and the candidates lack, and of excluded nodes.

    messages: as ``latest_user_text`` takes them; nodes, edges, items: as ``walks`` and ``candidate_rows`` take them (``path``, ``label``,
    ``signature`` among the nodes' columns). ``scan`` gives nodes, edges and items of a project whose graph is empty.
    """
    policy = resolve_policy(policy)
    if scan is not None and nodes.isEmpty():
        nodes, edges, items = scan()
    turns = turn_settings(latest_user_text(messages), settings)
    if nodes.isEmpty():
        none = turns.where("false").select(F.col("session").alias("request"), F.lit("").alias("id"), F.lit("").alias("reason"))
        return _verdicts(_without_graph(turns), nodes), none, none
    # sessions that agree in text and settings get the same rows: one of them is compiled
    turns, alike = _alike(turns)

    def of_each(df: DataFrame, name: str) -> DataFrame:
        rows = df.withColumnRenamed(name, "first_").join(alike, F.col("first_").eqNullSafe(F.col("stands_")))
        return rows.withColumnRenamed("session", name).select(*df.columns)

    turns = turn_targets(turns, nodes)
    ready = turns.where("code IS NULL")

    # sessions that agree in target, depth and forced nodes share one walk
    by_mode = lambda mode: nodes.where(F.col("mode") == mode).select("id")
    key = F.sha2(F.to_json(F.struct("target", "depth", "include", "exclude")), 256)
    ready = settle(ready.withColumns({"include": F.array_sort(F.array_distinct("include"))}).withColumn("walk", key))
    each = settle(ready.groupBy("walk").agg(*[F.first(c).alias(c) for c in ("target", "depth", "include", "exclude")]))
    kind = nodes.select(F.col("id").alias("target"), "type")
    entries = kind.join(small_side(each), "target").select("walk", F.col("target").alias("entry"), *[c.alias(n) for n, c in limits_of(policy, F.col("type") == "task", F.col("depth")).items()])
    entries = settle(entries)
    hidden, shown = small_side(by_mode("FORCE_EXCLUDE")), by_mode("FORCE_INCLUDE")
    # what the graph includes by hand is in every selection: one row with those ids, joined to each walk
    always = shown.agg(F.collect_set("id").alias("always"))
    off = each.select("walk", F.explode("exclude").alias("id"))
    on = each.crossJoin(F.broadcast(always)).select("walk", F.explode(F.concat("include", "always")).alias("id"))
    # what it excludes by hand is left out of what is walked, instead of being listed for each walk
    open_edges = edges.join(hidden.select(F.col("id").alias("source")), "source", "left_anti").join(hidden.select(F.col("id").alias("target")), "target", "left_anti")
    open_items = items.join(hidden.select(F.col("id").alias("functional")), "functional", "left_anti")
    selected, excluded, included = walks(nodes, open_edges, open_items, entries, off, on, 3)
    functions = selected_functions(selected.join(entries.select("walk", "entry"), "walk"), nodes, F.col("entry"))
    functions = settle(functions.select("walk", "id", "depth", "pos"))
    excluded, included = mapping_overrides(functions, items, excluded, included, ("walk",))
    excluded, included = settle(excluded), settle(included)

    def allowed(df: DataFrame, name: str = "id", by: str = "walk") -> DataFrame:
        """Without what the graph or the walk excludes."""
        return df.join(hidden.withColumnRenamed("id", name), name, "left_anti").join(excluded.select(by, F.col("id").alias(name)), [by, name], "left_anti")

    selected = settle(allowed(selected))
    texts = ready.select("walk", F.col("session").alias("request"), "text", "max_files")
    chosen = texts.select("walk", "request").join(selected, "walk")

    # Of each function the items that the task's words hit
    depth = policy["implementation"]["depth"]
    if depth > 0:
        most = F.least(F.greatest(F.lit(1), F.least(F.lit(5), F.col("max_files"))), F.lit(max(0, min(5, policy["implementation"].get("maxFiles", 3)))))
        # sessions of a walk whose texts have the same terms share the choice
        asks = settle(texts.select("walk", "request", F.array_sort(task_terms(F.col("text"), "functional")).alias("terms"), most.alias("most")))
        mine = items.join(functions.select("walk", F.col("id").alias("functional")), "functional").join(asks.select("walk", "terms", "most").distinct(), "walk")
        best = pick_implementations(mine, F.col("terms"), F.col("most"), ("walk", "terms", "most")).join(asks, ["walk", "terms", "most"]).drop("terms", "most")
        best = best.join(functions.select("walk", F.col("id").alias("functional"), "depth", "pos"), ["walk", "functional"]).join(nodes.select(F.col("id").alias("impl_id")), "impl_id", "left_semi")
        first = best.groupBy("walk", "request", F.col("impl_id").alias("id")).agg(F.min(F.struct("pos", "rank", "depth", "functional")).alias("f"))
        first = allowed(first).join(selected.select("walk", "id"), ["walk", "id"], "left_anti")
        first = first.select("walk", "request", "id", (F.col("f.depth") + depth).alias("depth"), F.concat(F.lit("implemented_by "), F.col("f.functional")).alias("reason"), F.lit("code,interface").alias("scope"), (F.col("f.pos") * 8 + F.col("f.rank") + (1 << 36)).alias("pos"))
        chosen = chosen.unionByName(first)
    chosen = settle(chosen)

    # Files whose symbols the task's words hit give way to those
    is_file = nodes.where("type IN ('code_module', 'implementation_file')").select("id")
    files = chosen.where(F.array_contains(F.split("scope", ","), "code")).join(is_file, "id", "left_semi")
    inside = contained(files.select("id").distinct(), edges.where("type = 'contains'").join(nodes.select(F.col("id").alias("target")), "target", "left_semi"))
    # sessions whose texts have the same terms share the hits
    asked = settle(files.select("walk", "request", F.col("id").alias("file")).join(texts.select("request", F.array_sort(task_terms(F.col("text"))).alias("terms")), "request"))
    asks = settle(asked.select("file", "terms").distinct().withColumn("ask", F.monotonically_increasing_id()))
    hits = symbol_hits(inside, nodes, F.col("terms"), by=("ask",), asks=asks)
    hits = settle(asked.join(asks, ["file", "terms"]).join(hits.drop("file"), "ask").drop("terms", "ask"))
    narrowed = hits.select("request", F.col("file").alias("id"), F.lit(True).alias("narrowed")).distinct()
    chosen = chosen.join(narrowed, ["request", "id"], "left").withColumn("scope", F.when(F.col("narrowed"), F.array_join(F.array_remove(F.split("scope", ","), "code"), ",")).otherwise(F.col("scope"))).drop("narrowed")
    place = files.select("request", F.col("id").alias("file"), F.col("depth").alias("file_depth"), F.col("pos").alias("file_pos"))
    symbols = allowed(hits, "symbol").join(place, ["request", "file"])
    last = symbols.groupBy("walk", "request", F.col("symbol").alias("id")).agg(F.max(F.struct("file_pos", "file_depth", "file", "rank")).alias("f"))
    last = last.select("walk", "request", "id", (F.col("f.file_depth") + 1).alias("depth"), F.concat(F.lit(NARROWED), F.col("f.file")).alias("reason"), F.lit("code,interface").alias("scope"), (F.col("f.file_pos") * 4 + F.col("f.rank") + (1 << 45)).alias("pos"))
    # a node chosen before keeps its place
    chosen = chosen.join(last.select("request", "id", F.col("reason").alias("now"), F.col("depth").alias("d")), ["request", "id"], "left")
    chosen = chosen.select("walk", "request", "id", F.coalesce("d", "depth").alias("depth"), F.coalesce("now", "reason").alias("reason"), F.when(F.col("now").isNotNull(), "code,interface").otherwise(F.col("scope")).alias("scope"), "pos").unionByName(last.join(chosen.select("request", "id"), ["request", "id"], "left_anti"))

    # Forced nodes, at the place that they have or at the end
    forced = allowed(included).join(nodes.select("id"), "id", "left_semi").join(texts.select("walk", "request"), "walk").select("request", "id", F.lit(True).alias("forced"))
    chosen = chosen.drop("walk").join(forced, ["request", "id"], "full_outer")
    by_hand = F.col("forced").isNotNull()
    chosen = chosen.select("request", "id", F.when(by_hand, 0).otherwise(F.col("depth")).alias("depth"), F.when(by_hand, "FORCE_INCLUDE").otherwise(F.col("reason")).alias("reason"), F.when(by_hand, FORCED_SCOPE).otherwise(F.col("scope")).alias("scope"), F.coalesce("pos", F.lit(1 << 50)).alias("pos"))
    about = ready.select(F.col("session").alias("request"), F.col("target").alias("entry"), F.col("text").alias("task"))
    chosen = settle(chosen)
    # of the nodes, only those that some request has
    wanted = small_side(chosen.select("id").unionByName(about.select(F.col("entry").alias("id"))).distinct())
    mine = settle(nodes.join(wanted, "id", "left_semi"))
    found, left = candidate_rows(chosen.join(about, "request"), mine, memory)
    entry = about.join(mine.select(F.col("id").alias("entry"), F.col("type").alias("node_type"), "status", F.col("priority").alias("priority_name")), "entry")

    def fixed(pos: int, priority: int, label: str, text: Column, scope: str, reason: str) -> DataFrame:
        return entry.select("request", F.col("entry").alias("node"), "node_type", "status", "priority_name", F.lit(1).alias("depth"), F.lit(reason).alias("reason"), F.lit(pos).cast("bigint").alias("pos"), F.lit(label).alias("label"), text.alias("content"), F.lit(scope).alias("scope"), F.lit(priority).alias("priority"), F.lit(True).alias("required"), F.lit(False).alias("force_include"))

    rows = found.unionByName(fixed(-2, 1000, "User task", F.col("task"), "task", "current request").where("content <> ''"))
    if rules.strip():
        rows = rows.unionByName(fixed(-1, 950, "Project rules", F.lit(rules), "project", "project rule"))
    place = F.row_number().over(Window.partitionBy("request").orderBy("pos", "node", "scope")).cast("bigint")
    rows = rows.withColumns({"ord": place, "raw": F.lit(False), "raw_kind": F.lit(None).cast("string")}).drop("pos")
    rows = settle(rows.join(ready.select(F.col("session").alias("request"), "token_budget"), "request"))
    selection = select_by_budget(rows, "token_budget", policy, contents=True)
    left = left.unionByName(excluded.join(nodes.select("id"), "id", "left_semi").join(texts.select("walk", "request"), "walk").select("request", "id", F.lit("FORCE_EXCLUDE").alias("reason")))
    return of_each(_verdicts(turns, nodes), "session"), of_each(selection, "request"), of_each(left, "request")


def _alike(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of turns with the same text and settings the first, and for which sessions it stands: ``stands_, session``."""
    own = [c for c in turns.columns if c != "session"]
    keyed = settle(turns.withColumn("like", F.unhex(F.sha2(F.to_json(F.struct(*own)), 256))))
    first = settle(keyed.groupBy("like").agg(F.min("session").alias("session"), *[F.first(c).alias(c) for c in own]))
    return first.drop("like"), settle(keyed.select("like", "session").join(first.select("like", F.col("session").alias("stands_")), "like").select("stands_", "session"))

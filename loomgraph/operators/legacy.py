"""Module compile for graphs that have code modules only (survey row K13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import select_by_budget

# Priorities of a module's own parts.
MEMORY_PRIORITY = {"context": 900, "interface": 890, "state": 850, "decisions": 820}


def compile_module(nodes: DataFrame, edges: DataFrame, memory: DataFrame, target: str, task: str, budget: int, include: list[str], exclude: list[str], rules: str = "", history: str = "", policy: dict | None = None) -> DataFrame:
    """Task, rules, source and memory of the target, then what its edges ask for of other modules, then history, selected by budget.

    nodes: ``id, code, mode``; edges: ``ord, source, target, type, mode, scope`` (by commas); memory: ``module, scope, text``.
    """
    spark = nodes.sparkSession
    shape = "ord bigint, priority int, label string, content string, node string, scope string, required boolean, reason string"
    own = spark.createDataFrame(
        [(0, 1000, "User task", task, target, "task", True, "legacy module context"), (1, 950, "Project rules", rules, None, "project", True, "legacy module context"), (1 << 40, 400, f"{target} relevant git history", history, target, "history", False, "legacy module context")], shape
    )
    source = nodes.where(F.col("id") == target).select(F.lit(2).cast("bigint").alias("ord"), F.lit(920).alias("priority"), F.concat("id", F.lit(" source")).alias("label"), F.col("code").alias("content"), F.col("id").alias("node"), F.lit("code").alias("scope"), F.lit(False).alias("required"), F.lit("current target implementation").alias("reason"))
    rank = F.element_at(F.create_map(*[x for k, v in MEMORY_PRIORITY.items() for x in (F.lit(k), F.lit(v))]), F.col("scope"))
    mine = memory.where((F.col("module") == target) & F.col("scope").isin(list(MEMORY_PRIORITY))).select((F.lit(1000) - rank).cast("bigint").alias("ord"), rank.alias("priority"), F.concat_ws(" ", "module", "scope").alias("label"), F.col("text").alias("content"), F.col("module").alias("node"), "scope", F.lit(True).alias("required"), F.lit("legacy module context").alias("reason"))
    out_of = edges.where(F.col("source") == target)
    off = (F.col("mode") == "FORCE_EXCLUDE") | (F.col("type") == "force_exclude")
    on = (F.col("mode") == "FORCE_INCLUDE") | (F.col("type") == "force_include")
    stated = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    gone = stated(exclude).unionByName(nodes.where("mode = 'FORCE_EXCLUDE'").select("id")).unionByName(out_of.where(off).select(F.col("target").alias("id"))).distinct()
    forced = stated(include).unionByName(nodes.where("mode = 'FORCE_INCLUDE'").select("id")).unionByName(out_of.where(on & ~off).select(F.col("target").alias("id"))).distinct()
    linked = out_of.where(~off).groupBy(F.col("target").alias("id")).agg(F.max_by(F.struct("ord", "type", "mode", "scope"), "ord").alias("e")).select("id", "e.*")
    force = forced.join(nodes.select("id"), "id", "left_semi").where(F.col("id") != target).select("id", F.lit(1 << 30).cast("bigint").alias("ord"), F.lit("force_include").alias("type"), F.lit("FORCE_INCLUDE").alias("mode"), F.lit("interface,state,decisions").alias("scope"))
    chosen = linked.join(force.select("id"), "id", "left_anti").unionByName(force).join(gone, "id", "left_anti")
    scopes = F.split(F.when(F.col("scope") != "", F.col("scope")).when(F.col("type") == "interface", "interface").otherwise("interface,state"), ",")
    asked = chosen.select("id", "ord", "type", "mode", F.posexplode(scopes).alias("k", "scope"))
    texts = memory.select(F.col("module").alias("id"), "scope", "text").unionByName(nodes.select("id", F.lit("code").alias("scope"), F.col("code").alias("text")))
    is_forced = (F.col("mode") == "FORCE_INCLUDE") | (F.col("type") == "force_include")
    others = asked.join(texts, ["id", "scope"]).select(
        (F.lit(1 << 20) + F.col("ord") * 16 + F.col("k")).cast("bigint").alias("ord"), F.when(is_forced, 780).when(F.col("type") == "optional", 300).otherwise(650).alias("priority"), F.concat_ws(" ", "id", "scope").alias("label"), F.col("text").alias("content"), F.col("id").alias("node"), "scope", F.lit(False).alias("required"),
        F.when(is_forced, "FORCE_INCLUDE").otherwise(F.concat("type", F.lit(f" from {target}"))).alias("reason"),
    )
    rows = own.unionByName(source).unionByName(mine).unionByName(others).join(forced.select(F.col("id").alias("node"), F.lit(True).alias("f")), "node", "left")
    kind = F.when(F.col("scope") == "project", "project_rule").otherwise("code_module")
    rows = rows.select("*", F.coalesce("f", F.lit(False)).alias("force_include"), kind.alias("node_type"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("priority_name"), F.when(F.col("node") == target, 0).otherwise(1).alias("depth"), F.lit(False).alias("raw"), F.lit(None).cast("string").alias("raw_kind"), F.lit(target).alias("request")).drop("f")
    return select_by_budget(rows, budget, policy)

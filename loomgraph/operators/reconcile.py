"""Reconciliation of a scanned index with the stored graph, and invalidation (survey rows R1-R13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import reach
from .store import is_implementation

TRIPLE = ["source", "target", "type"]


def tombstone_closure(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Deleted ids and all they contain."""
    return reach(edges.where("type = 'contains'"), deleted).select("id")


def drop_tombstoned(nodes: DataFrame, edges: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R2: nodes, edges and mapping items (``functional, impl_id``) without deleted ids; a mapping without items is gone with them."""
    out = edges
    for end in ("source", "target"):
        out = out.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(gone, "id", "left_anti"), out, items.join(gone.select(F.col("id").alias("impl_id")), "impl_id", "left_anti")


def mark_stale(nodes: DataFrame, scanned: DataFrame) -> DataFrame:
    """Code nodes that the scan no longer finds become stale; nothing is deleted. Adds ``stale_now``."""
    seen = scanned.select("id").distinct().withColumn("seen_", F.lit(True))
    lost = is_implementation(F.col("type")) & (F.col("source") == "code") & F.col("seen_").isNull()
    return nodes.join(seen, "id", "left").withColumn("stale_now", F.coalesce(lost, F.lit(False))).withColumn("status", F.when(F.col("stale_now"), "stale").otherwise(F.col("status"))).drop("seen_")


def upsert_nodes(nodes: DataFrame, discovered: DataFrame) -> DataFrame:
    """``id, type, path, status, created``: known nodes take the new path and come back from stale; new files are code modules."""
    new = discovered.select("id", F.col("type").alias("type_"), F.col("path").alias("path_")).withColumn("found", F.lit(True))
    both = nodes.select("id", "type", "path", "status").withColumn("known", F.lit(True)).join(new, "id", "full_outer")
    kind = F.when(F.col("type_") == "implementation_file", "code_module").otherwise(F.col("type_"))
    back = F.col("found") & (F.col("status") == "stale")
    status = F.when(F.col("known").isNull() | F.coalesce(back, F.lit(False)), "active").otherwise(F.col("status"))
    return both.select("id", F.coalesce("type", kind).alias("type"), F.coalesce(F.nullif("path_", F.lit("")), "path").alias("path"), status.alias("status"), F.col("known").isNull().alias("created"))


def refresh_edges(edges: DataFrame, discovered: DataFrame) -> DataFrame:
    """``source, target, type, mode, origin``: edges by hand and by others stay, analysed ones only if found again, new ones come.

    edges: with ``mode`` and ``made_by`` (``implementation-analyzer`` for analysed ones).
    """
    found = discovered.select(*TRIPLE).distinct()
    own = F.coalesce(~F.col("mode").isin("MANUAL", "FORCE_INCLUDE", "FORCE_EXCLUDE"), F.lit(True)) & F.coalesce(F.col("made_by") == "implementation-analyzer", F.lit(False))
    kept = edges.where(~own).unionByName(edges.where(own).join(found, TRIPLE, "left_semi"))
    new = found.join(kept.select(*TRIPLE), TRIPLE, "left_anti").select(*TRIPLE, F.lit("AUTO").alias("mode"), F.lit("new").alias("origin"))
    return kept.select(*TRIPLE, "mode", F.lit("kept").alias("origin")).unionByName(new)


def suggest_missing(imports: DataFrame, edges: DataFrame) -> DataFrame:
    """Resolved imports (``source, target``) between different modules that no edge of any type says."""
    return imports.where("source <> target").select("source", "target").distinct().join(edges.select("source", "target"), ["source", "target"], "left_anti")


def suggest_stale(imports: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Automatic dependency edges between modules that no import backs."""
    auto = edges.where((F.upper(F.coalesce("mode", F.lit("AUTO"))) == "AUTO") & F.col("type").isin("dependency", "interface", "depends_on"))
    for end in ("source", "target"):
        auto = auto.join(modules.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return auto.join(imports.where("source <> target").select("source", "target").distinct(), ["source", "target"], "left_anti").select("source", "target", "type")


def invalidate(nodes: DataFrame, items: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a change of modules, symbols, interfaces or files (``kind, id``) does to mappings and nodes.

    items: ``functional, mode, impl_id, path``. Returns mappings ``functional, status`` (manual ones are to be reviewed, others
    stale) and nodes ``id, status, invalidation`` (manual ones keep their status).
    """
    hit = items.join(changed.where("kind in ('module', 'symbol')").select(F.col("id").alias("impl_id")).distinct().withColumn("a", F.lit(1)), "impl_id", "left")
    hit = hit.join(changed.where("kind = 'file'").select(F.col("id").alias("path")).distinct().withColumn("b", F.lit(1)), "path", "left").where("a is not null or b is not null")
    mappings = hit.groupBy("functional", "mode").agg(F.lit(1).alias("x")).select("functional", F.when(F.col("mode") == "MANUAL", "review_required").otherwise("stale").alias("status"))
    functions = mappings.select(F.col("functional").alias("id")).distinct()
    contracts = nodes.where("type = 'interface'")
    by_module = contracts.join(changed.where("kind = 'module'").select(F.col("id").alias("module")).distinct(), "module", "left_semi").select("id")
    by_name = contracts.withColumn("name_", F.coalesce("qualified_id", "id")).join(changed.where("kind = 'interface'").select(F.col("id").alias("name_")).distinct(), "name_", "left_semi").select("id")
    touched = nodes.where("type = 'functional'").join(functions, "id", "left_semi").select("id").unionByName(by_module).unionByName(by_name).distinct()
    manual = F.col("mode") == "MANUAL"
    out = nodes.join(touched, "id", "left_semi").select("id", F.when(manual, F.col("status")).otherwise("stale").alias("status"), F.when(manual, "review_required").otherwise("stale").alias("invalidation"))
    return mappings, out

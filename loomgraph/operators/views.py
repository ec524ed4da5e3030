"""View queries: hierarchy, closure, layers, filters (survey rows V1-V10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closure import reach, settle
from .store import is_implementation


def implementation_level(kind: Column) -> Column:
    """V3: 0 for files, 1 for classes, 2 for functions, 3 for symbols."""
    return F.when(kind == "implementation_class", 1).when(kind == "implementation_function", 2).when(kind == "implementation_symbol", 3).otherwise(0)


def hierarchy_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """V1: ``id, parent``: the first ``contains`` edge's source, else the stated container, else the longest id that leads the node's,
    else the only deepest (or only file) node of its path.

    Leading ids are equi-joined: the cuts of an id at dots, colons and hashes are the candidates, not all other nodes.
    """
    code = nodes.where(is_implementation(F.col("type"))).withColumn("lv", implementation_level(F.col("type")))
    ids = code.select("id")
    src = edges.where("type = 'contains' and source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    by_edge = src.groupBy(F.col("target").alias("id")).agg(F.min_by("source", "ord").alias("p1"))
    low = code.select(F.col("id").alias("cand"), F.col("lv").alias("clv"), F.col("path").alias("cpath"))
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.length("id")), lambda i: F.when(F.substring(F.col("id"), i, F.lit(1)).isin(".", ":", "#"), F.substring(F.col("id"), F.lit(1), i - 1))), lambda x: x.isNotNull())
    lead = code.where("lv > 0").select("id", "lv", F.explode(cuts).alias("cand")).join(low, "cand").where("clv < lv").groupBy("id").agg(F.max_by("cand", F.length("cand")).alias("p3"))
    # per path, for each level below a node's: how many candidates there are and which (levels are four at most)
    per = low.where("cpath <> ''").groupBy("cpath", "clv").agg(F.count("*").alias("n"), F.min("cand").alias("one"))
    same = code.where("lv > 0 and path <> ''").select("id", "lv", F.col("path").alias("cpath")).join(per, "cpath").where("clv < lv")
    by_path = same.groupBy("id").agg(F.max_by(F.struct("n", "one"), "clv").alias("deep"), F.max(F.when((F.col("clv") == 0) & (F.col("n") == 1), F.col("one"))).alias("file"))
    by_path = by_path.select("id", F.coalesce(F.when(F.col("deep.n") == 1, F.col("deep.one")), "file").alias("p4"))
    out = code.select("id", *(["container"] if "container" in nodes.columns else [])).join(by_edge, "id", "left").join(lead, "id", "left").join(by_path, "id", "left")
    stated = F.lit(None).cast("string")
    if "container" in nodes.columns:
        out = out.join(ids.withColumnRenamed("id", "box"), (F.col("container") == F.col("box")) & (F.col("container") != F.col("id")), "left")
        stated = F.col("box")
    return out.select("id", F.coalesce("p1", stated, "p3", "p4").alias("parent")).where("parent is not null")


def descendants(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """V2: all that seeds contain, with depth; cycles end."""
    ids = nodes.select("id")
    inside = edges.where("type = 'contains'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return reach(inside, seeds).where("depth > 0")


def ancestors(parents: DataFrame, seeds: DataFrame) -> DataFrame:
    """V2: all parents above the seeds."""
    return reach(parents.select(F.col("id").alias("source"), F.col("parent").alias("target")), seeds).where("depth > 0")


def layer_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """V4: ``id, level``: breadth-first levels from nodes without incoming edges; then from the first node not reached, and so on.

    What no root reaches is reached first from the first node (by ``ord``) that leads to it at all, and every way from there lies among
    nodes of the same first node. So first nodes are found for all at once, and one search goes from all of them.
    """
    ids = nodes.select("id")
    own = settle(edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target").distinct())
    roots = ids.join(own.select(F.col("target").alias("id")), "id", "left_anti")
    levels = settle(reach(own, roots).withColumnRenamed("depth", "level"))
    rest = settle(nodes.select("id", "ord").join(levels, "id", "left_anti"))
    if rest.isEmpty():
        return levels
    inner = settle(own.join(rest.select(F.col("id").alias("target")), "target", "left_semi").join(rest.select(F.col("id").alias("source")), "source", "left_semi"))
    first = first_ancestors(rest, inner)
    ends = lambda end: first.select(F.col("id").alias(end), F.col("first").alias(f"{end}_first"))
    same = inner.join(ends("source"), "source").join(ends("target"), "target").where("source_first = target_first")
    return levels.unionByName(reach(same.select("source", "target"), first.where("id = first").select("id")).withColumnRenamed("depth", "level"))


def first_ancestors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, first``: of all nodes that lead to a node, itself included, the first by ``ord``.

    In a round a node takes the least of what its sources have, and what the node that it has got has: what leads to that one leads
    here too, so the distance that is looked back over grows by a factor, and a long cycle takes few rounds.
    """
    mine = F.struct("ord", "id")
    known = settle(nodes.select("id", mine.alias("best")))
    while True:
        near = edges.join(known.select(F.col("id").alias("source"), F.col("best").alias("b")), "source").groupBy(F.col("target").alias("id")).agg(F.min("b").alias("b"))
        step = known.join(near, "id", "left").select("id", F.col("best").alias("was"), F.least("best", F.coalesce("b", "best")).alias("best"))
        far = known.select(F.col("id").alias("via"), F.col("best").alias("beyond"))
        step = step.withColumn("via", F.col("best.id")).join(far, "via").select("id", "was", F.least("best", "beyond").alias("best"))
        step = settle(step)
        known = step.select("id", "best")
        if step.where("was <> best").isEmpty():
            return known.select("id", F.col("best.id").alias("first"))


def layer_positions(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """V4: ``id, x, y``: the nodes of a level in columns of about the root of their number."""
    n = levels.groupBy("level").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("level").orderBy("ord")) - 1
    rows = levels.join(nodes.select("id", "ord"), "id").withColumn("k", at).join(n, "level")
    per = F.greatest(F.lit(1), F.floor(F.sqrt("n"))).cast("int")
    return rows.select("id", (36 + (F.col("level") + F.floor(F.col("k") / per)) * 245).alias("x"), (52 + (F.col("k") % per) * 126).alias("y"))


def bounding_box(nodes: DataFrame) -> DataFrame:
    """V5: the box around all nodes."""
    return nodes.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def fit_zoom(width: Column, height: Column, view_width: float, view_height: float) -> Column:
    """V5: a zoom that shows the whole box, within .3 and 1.2."""
    z = F.least(F.lit(view_width) / F.greatest(width, F.lit(1.0)), F.lit(view_height) / F.greatest(height, F.lit(1.0)))
    return F.least(F.greatest(z, F.lit(0.3)), F.lit(1.2))


def view_filter(nodes: DataFrame, edges: DataFrame, view: str, text: str = "", kinds: list[str] | None = None, max_level: int = 3) -> DataFrame:
    """V6: ids of a view: semantic (no implementation), implementation (with the ancestors of what is found) or all."""
    code = is_implementation(F.col("type"))
    rows = nodes.where(code & (implementation_level(F.col("type")) <= max_level)) if view == "implementation" else nodes.where(~code) if view == "semantic" else nodes
    if kinds:
        rows = rows.where(F.col("type").isin(kinds))
    if text:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "id", F.coalesce("title", F.lit("")))), F.lit(text.lower())))
    ids = rows.select("id")
    if view == "implementation" and text:
        ids = ids.unionByName(ancestors(hierarchy_parents(nodes, edges), ids).select("id")).distinct()
    return ids


def display_edges(edges: DataFrame, items: DataFrame, visible: DataFrame) -> DataFrame:
    """V7: edges and ``implemented_by`` edges of mappings between visible nodes."""
    derived = items.select(F.col("functional").alias("source"), F.col("impl_id").alias("target"), F.lit("implemented_by").alias("type"))
    both = edges.select("source", "target", "type").unionByName(derived)
    for end in ("source", "target"):
        both = both.join(visible.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return both.select("source", "target", "type")


def manifest_metrics(totals: DataFrame, budget: int) -> DataFrame:
    """Figures of a selection (``audit_totals``) as shown: shares and whether the budget holds."""
    return totals.withColumns({"used_share": F.round(F.col("selected_tokens") / budget, 4), "left_out": F.col("n_candidates") - F.col("n_included"), "valid": F.col("selected_tokens") <= budget})

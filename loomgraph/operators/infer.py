"""Functional inference and graph surgery (survey rows M1-M10, K16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HELPER_NAMES, domain_key, slug, term_hits, title_case
from .store import is_implementation

# Fixed value: file names that make good titles.
PREFERRED = r"(?i)^(asr|api|auth|router|routing|record|encoder|subtitle|speaker|capture)"


def capability_groups(nodes: DataFrame) -> DataFrame:
    """M1, M3: ``ord, id, path, domain`` of active implementation nodes."""
    active = nodes.where(is_implementation(F.col("type")) & F.coalesce(F.col("status").isin("active", ""), F.lit(True)))
    return active.select("ord", "id", "path", domain_key(F.col("path"), F.col("id")).alias("domain"))


def functional_titles(groups: DataFrame) -> DataFrame:
    """M4, M5: ``domain, n_members, first, title, functional``: the title is the domain's, or that of a telling file name.

    Names are picked by ordered aggregates. Domains with equal titles are told apart by a number in order of first appearance.
    """
    file = F.regexp_replace(F.element_at(F.split(F.coalesce(F.nullif("path", F.lit("")), F.col("id")), "/"), -1), r"\.[^.]+$", "")
    named = groups.withColumn("file", file)
    pick = lambda ok: F.min(F.when((F.col("file") != "") & ok, F.struct("ord", "file")))["file"]
    per = named.groupBy("domain").agg(
        F.count("*").alias("n_members"), F.min("ord").alias("first"), pick(F.col("file").rlike(PREFERRED)).alias("a"), pick(~F.lower("file").isin(HELPER_NAMES)).alias("b"), pick(F.lit(True)).alias("c")
    )
    telling = ~F.col("domain").isin(HELPER_NAMES) & (F.col("domain") != "")
    title = title_case(F.when(telling, F.col("domain")).otherwise(F.coalesce("a", "b", "c", F.lit("Capability"))))
    per = per.select("domain", "n_members", "first", title.alias("title"))
    base = F.concat(F.lit("function."), slug(F.col("title")))
    k = F.row_number().over(Window.partitionBy("base").orderBy("first"))
    return per.withColumn("base", base).withColumn("k", k).select("domain", "n_members", "first", "title", F.when(F.col("k") > 1, F.concat_ws("-", "base", "k")).otherwise(F.col("base")).alias("functional"))


def infer_functional(nodes: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M6: functional nodes (``functional, title, n_members, confidence, action``), mapping items and ``depends_on`` edges.

    action: new, update (an automatic node is there) or kept (one by hand is).
    """
    groups = capability_groups(nodes)
    titles = functional_titles(groups)
    there = nodes.where("type = 'functional'").select(F.col("id").alias("functional"), F.upper(F.coalesce("mode", F.lit("AUTO"))).alias("m"))
    found = titles.join(there, "functional", "left")
    action = F.when(F.col("m").isNull(), "new").when(F.col("m") == "AUTO", "update").otherwise("kept")
    out = found.select("functional", "title", "n_members", F.when(F.col("n_members") > 1, 0.78).otherwise(0.58).alias("confidence"), action.alias("action"))
    items = groups.join(titles.select("domain", "functional"), "domain").select("functional", "id", "path", "ord")
    return out, items, functional_edges(items, relationships)


def functional_edges(items: DataFrame, relationships: DataFrame) -> DataFrame:
    """M6: the first relationship between two capabilities makes an edge, with a confidence of 0.8 at most."""
    member = items.select("id", "functional")
    ends = relationships.join(member.withColumnsRenamed({"id": "from", "functional": "source"}), "from").join(member.withColumnsRenamed({"id": "to", "functional": "target"}), "to").where("source <> target")
    first = ends.groupBy("source", "target").agg(F.min_by("confidence", "ord").alias("c"))
    return first.select("source", "target", F.least(F.lit(0.8), F.coalesce(F.nullif("c", F.lit(0.0)), F.lit(0.7))).alias("confidence"))


def apply_inference(mappings: DataFrame, proposed: DataFrame, manual_nodes: DataFrame) -> DataFrame:
    """M7: ``functional, verdict`` for proposed mapping items (``functional, id``) against stored ones (``functional, id, mode,
    created_by``): owned by hand and equal, owned and to be reviewed, replaced, or new."""
    ids = lambda df, name: df.groupBy("functional").agg(F.sort_array(F.collect_set("id")).alias(name))
    by_hand = mappings.where(F.upper(F.coalesce("mode", F.lit("AUTO"))) != "AUTO")
    auto = mappings.where(F.upper(F.coalesce("mode", F.lit("AUTO"))) == "AUTO").select("functional").distinct().withColumn("had", F.lit(True))
    owner = manual_nodes.select(F.col("id").alias("functional")).distinct().withColumn("node", F.lit(True))
    out = ids(proposed, "new").join(ids(by_hand, "own"), "functional", "left").join(owner, "functional", "left").join(auto, "functional", "left")
    owned = F.col("own").isNotNull() | F.col("node").isNotNull()
    same = F.col("new") == F.coalesce("own", F.array().cast("array<string>"))
    return out.select("functional", F.when(owned & same, "owned").when(owned, "review_required").when(F.col("had"), "replaced").otherwise("new").alias("verdict"))


def pick_implementations(items: DataFrame, terms: Column, most: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """``functional, impl_id, hits, rank``: of a capability's items those that task terms hit, most hits first, else the first two.

    items: ``functional, impl_id, path, capabilities, ord``; of one id the first place and the last row's values count. ``by``: columns
    of the request, which ``terms`` and ``most`` may depend on.
    """
    said = F.array_join(F.coalesce("capabilities", F.array().cast("array<string>")), " ") if "capabilities" in items.columns else F.lit("")
    most = most if isinstance(most, Column) else F.lit(most)
    once = items.withColumns({"said": said, "terms_": terms, "most_": most}).groupBy(*by, "functional", "impl_id").agg(F.min("ord").alias("ord"), F.max_by(F.struct("path", "said"), "ord").alias("v"), F.first("terms_").alias("terms_"), F.first("most_").alias("most_"))
    text = F.concat_ws(" ", F.col("impl_id"), F.coalesce("v.path", F.lit("")), F.coalesce("v.said", F.lit("")))
    scored = once.withColumn("hits", term_hits(text, F.col("terms_")))
    each = Window.partitionBy(*by, "functional")
    ranked = scored.withColumn("top", F.max("hits").over(each)).where((F.col("top") == 0) | (F.col("hits") > 0)).withColumn("rank", F.row_number().over(each.orderBy(F.desc("hits"), "ord")))
    return ranked.where(F.col("rank") <= F.when(F.col("top") > 0, F.col("most_")).otherwise(F.least(F.lit(2), F.col("most_")))).select(*by, "functional", "impl_id", "hits", "rank")


def merge_functional(edges: DataFrame, items: DataFrame, sources: list[str], merged: str) -> tuple[DataFrame, DataFrame]:
    """M9: edges with the merged nodes as one (no self-edges), and their items once each."""
    one = lambda c: F.when(F.col(c).isin(sources), merged).otherwise(F.col(c))
    joined = edges.withColumns({"source": one("source"), "target": one("target")}).where("source <> target")
    moved = items.where(F.col("functional").isin(sources)).groupBy("impl_id").agg(F.min("ord").alias("ord")).select(F.lit(merged).alias("functional"), "impl_id", "ord")
    return joined, items.where(~F.col("functional").isin(sources)).select("functional", "impl_id", "ord").unionByName(moved)


def split_functional(edges: DataFrame, source: str, splits: DataFrame) -> DataFrame:
    """Each edge of a node once for every part (``id``), by hand; other edges as they are. Parts are few and stated."""
    touching = (F.col("source") == source) | (F.col("target") == source)
    parts = F.broadcast(splits.select(F.col("id").alias("part")))  # the caller's list of parts
    many = edges.where(touching).crossJoin(parts).withColumns({"source": F.when(F.col("source") == source, F.col("part")).otherwise(F.col("source")), "target": F.when(F.col("target") == source, F.col("part")).otherwise(F.col("target")), "mode": F.lit("MANUAL")}).drop("part")
    return edges.where(~touching).unionByName(many)


def check_split(items: DataFrame, source: str, wanted: DataFrame) -> DataFrame:
    """Items asked for (``id``) that the node does not have."""
    return wanted.join(items.where(F.col("functional") == source).select(F.col("impl_id").alias("id")), "id", "left_anti")

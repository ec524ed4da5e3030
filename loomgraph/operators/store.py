"""Graph store: normalise, validate, summarise (survey rows G1-G11, S2, S3, S23, S24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import filled, token_estimate
from .closure import settle


def empty_graph(spark: SparkSession) -> dict[str, DataFrame]:
    """S3: the tables of an empty graph."""
    shapes = {"nodes": schema.NODES, "edges": schema.EDGES, "mappings": schema.MAPPINGS, "overrides": schema.OVERRIDES}
    return {name: spark.createDataFrame([], shape) for name, shape in shapes.items()}


def canonical_mode(mode: Column) -> Column:
    """Upper-cased, AUTO by default."""
    return F.upper(F.coalesce(F.nullif(mode, F.lit("")), F.lit("AUTO")))


def is_implementation(kind: Column) -> Column:
    """Code modules and all implementation types."""
    return F.coalesce((kind == "code_module") | F.startswith(kind, F.lit("implementation_")), F.lit(False))


def clamp(col: Column, low: int, high: int) -> Column:
    """An integer held in its range."""
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def normalize_nodes(nodes: DataFrame, now: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """G1: defaults for every column that the table has; ``now`` is a parameter so that results repeat."""
    c = {name: F.col(name) if name in nodes.columns else F.lit(None).cast("string") for name in ("type", "title", "label", "id", "content", "description", "source", "created_by", "confidence", "priority", "status", "mode", "created_at", "updated_at", "last_verified")}
    given = F.coalesce(F.nullif(c["type"], F.lit("")), F.lit("code_module"))
    code = is_implementation(given)
    finite = lambda x: F.when(~F.isnan(x.cast("double")), F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))
    author = F.when(c["source"] == "assistant", "ai").when((c["source"] == "code") | code, "analyzer").when(c["source"] == "derived", "auto").when(c["source"] == "system", "plugin").otherwise("user")
    meta = F.get_json_object("metadata", "$.confidence") if "metadata" in nodes.columns else F.lit(None).cast("string")
    out = {
        "type": F.when(c["type"].isin(schema.NODE_TYPES), c["type"]).otherwise("code_module"),
        "title": filled(c["title"], c["label"], c["id"]),
        "label": filled(c["label"], c["title"], c["id"]),
        "content": F.coalesce(c["content"], c["description"], F.lit("")),
        "description": F.coalesce(c["description"], c["content"], F.lit("")),
        "source": filled(c["source"], F.when(code, F.lit("code")).otherwise(F.lit("user"))),
        "created_by": filled(c["created_by"], author),
        "confidence": F.coalesce(finite(c["confidence"]), finite(meta), F.lit(1.0)),
        "priority": F.when(c["priority"].isin(schema.PRIORITIES), c["priority"]).otherwise("normal"),
        "status": F.when(c["status"].isin(schema.STATUSES), c["status"]).otherwise("active"),
        "mode": canonical_mode(c["mode"]),
        "created_at": filled(c["created_at"], F.lit(now)),
        "updated_at": filled(c["updated_at"], c["created_at"], F.lit(now)),
        "last_verified": filled(c["last_verified"], c["updated_at"], c["created_at"], F.lit(now)),
    }
    return nodes.withColumns(out)


def normalize_edges(edges: DataFrame) -> DataFrame:
    """G1: an edge's type and mode; forced types force the mode."""
    forced = F.when(F.col("type") == "force_include", "FORCE_INCLUDE").when(F.col("type") == "force_exclude", "FORCE_EXCLUDE")
    return edges.withColumns({"type": filled(F.col("type"), F.lit("related_to")), "mode": canonical_mode(filled(F.col("mode"), forced))})


def validate_graph(nodes: DataFrame, edges: DataFrame, mapping_items: DataFrame | None = None) -> DataFrame:
    """One row ``code, subject, detail`` a violation; empty for a valid graph. mapping_items: ``functional, impl_id``."""
    row = lambda df, code, subject, detail: df.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))
    has = lambda name: name in nodes.columns
    found = [
        row(nodes.groupBy("id").count().where("count > 1"), "DUPLICATE_ID", F.col("id"), F.col("count")),
        row(nodes.where(F.col("id").isNull() | (F.col("id") == "")), "EMPTY_ID", F.col("ord"), F.lit(None)),
    ]
    for name, allowed in (("type", schema.NODE_TYPES), ("priority", schema.PRIORITIES), ("status", schema.STATUSES)):
        if has(name):
            found.append(row(nodes.where((F.col(name) != "") & ~F.col(name).isin(allowed)), f"UNSUPPORTED_{name.upper()}", F.col("id"), F.col(name)))
    if has("confidence"):
        bad = F.isnan("confidence") | ~F.col("confidence").between(0, 1)
        found.append(row(nodes.where(F.col("confidence").isNotNull() & bad), "UNSUPPORTED_CONFIDENCE", F.col("id"), F.lit(None)))
    ids = nodes.select(F.col("id").alias("known")).distinct()
    ends = edges.select("ord", "source", "target", F.explode(F.array("source", "target")).alias("end"))
    lost = ends.join(ids, F.col("end") == F.col("known"), "left_anti").select("ord", "source", "target").distinct()
    found.append(row(lost, "UNKNOWN_ENDPOINT", F.concat_ws(" -> ", "source", "target"), F.col("ord")))
    found.append(row(edges.where(~F.coalesce(F.col("type").isin(schema.RELATION_TYPES), F.lit(False))), "UNSUPPORTED_RELATION", F.col("ord"), F.col("type")))
    found.append(row(edges.where(~canonical_mode(F.col("mode")).isin(schema.MODES)), "UNSUPPORTED_MODE", F.col("ord"), F.col("mode")))
    if "scope" in edges.columns:
        found.append(row(edges.select("ord", F.explode("scope").alias("s")).where(~F.col("s").isin(schema.SCOPES)), "UNSUPPORTED_SCOPE", F.col("ord"), F.col("s")))
    if mapping_items is not None:
        functional = nodes.where("type = 'functional'").select(F.col("id").alias("known")).distinct()
        found.append(row(mapping_items.select("functional").distinct().join(functional, F.col("functional") == F.col("known"), "left_anti"), "UNKNOWN_MAPPING_SOURCE", F.col("functional"), F.lit(None)))
        found.append(row(mapping_items.join(ids, F.col("impl_id") == F.col("known"), "left_anti"), "UNKNOWN_MAPPING_TARGET", F.col("functional"), F.col("impl_id")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def summarize_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 100, max_edges: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first nodes, the first edges that touch them, and one row of counts. Both limits are the feature."""
    n, m = max(1, min(500, max_nodes)), max(1, min(1000, max_edges))
    some = nodes.orderBy("ord").limit(n)
    ids = some.select("id").distinct()  # at most 500 rows
    starts, ends = (F.broadcast(ids.select(F.col("id").alias(c))) for c in ("known_source", "known_target"))
    touching = edges.join(starts, F.col("source") == F.col("known_source"), "left").join(ends, F.col("target") == F.col("known_target"), "left")
    touching = touching.where("known_source is not null or known_target is not null").drop("known_source", "known_target")
    shown = touching.orderBy("ord").limit(m)
    total = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(some.agg(F.count("*").alias("shown_nodes"))).crossJoin(shown.agg(F.count("*").alias("shown_edges")))
    return some, shown, total.withColumn("truncated", (F.col("shown_nodes") < F.col("nodes")) | (F.col("shown_edges") < F.col("edges")))


def graph_revision(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One hash of the graph's content, whatever the partitioning: the sum of row hashes, hashed with the counts."""
    part = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).alias("s"))
    both = part(nodes).select(F.concat_ws(":", F.col("n"), F.col("s")).alias("a")).crossJoin(part(edges).select(F.concat_ws(":", F.col("n"), F.col("s")).alias("b")))
    return both.select(F.sha2(F.concat_ws("|", "a", "b"), 256).alias("revision"))


def raw_context_tokens(nodes: DataFrame) -> DataFrame:
    """Tokens of conversation and raw nodes."""
    raw = (F.col("type") == "conversation") | F.coalesce(F.col("raw"), F.lit(False)) if "raw" in nodes.columns else F.col("type") == "conversation"
    return nodes.where(raw).agg(F.coalesce(F.sum(token_estimate(F.col("content"))), F.lit(0)).alias("raw_tokens"))


def display_source(scope: Column, path: Column, source: Column) -> Column:
    """Where a piece of context comes from."""
    return F.when(scope == "project", ".context/project.md").when(scope == "task", "current request").when((scope == "code") & (path != ""), path).otherwise(filled(source, path, F.lit("graph")))


def placed_by_index(nodes: DataFrame) -> DataFrame:
    """Four columns by place, without a look at overlaps."""
    return nodes.withColumns({"x": 80.0 + (F.col("ord") % 4) * 260, "y": 80.0 + F.floor(F.col("ord") / 4) * 180})


def free_slots(placed: DataFrame, wanted: int) -> list[tuple[int, int]]:
    """The first free cells of a four-column grid, one after another, for ``wanted`` new nodes.

    A cell is taken if a placed node lies within 220 by 140 of it. A driver-side step: only cells that nodes block come to the
    driver, and no more of the grid is looked at than ``wanted`` and the blocked cells need (10 000 at most).
    """
    cells = 10_000
    rows = placed.where("x is not null and y is not null").select(((F.col("x") - 80) / 260).alias("cx"), ((F.col("y") - 80) / 180).alias("cy"))
    near = rows.select(F.explode(F.sequence(F.floor("cx"), F.ceil("cx"))).alias("col"), "cx", "cy").select("col", "cx", "cy", F.explode(F.sequence(F.floor("cy"), F.ceil("cy"))).alias("row"))
    hit = near.where((F.abs(F.col("cx") - F.col("col")) * 260 < 220) & (F.abs(F.col("cy") - F.col("row")) * 180 < 140) & F.col("col").between(0, 3) & F.col("row").between(0, cells // 4 - 1))
    taken = {(r.col, r.row) for r in hit.select("col", "row").distinct().collect()}
    free = ((k % 4, k // 4) for k in range(cells) if (k % 4, k // 4) not in taken)
    return [(80 + c * 260, 80 + r * 180) for (c, r), _ in zip(free, range(wanted))]


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``k``, its rows' numbers from 1 by the columns ``order``: a range sort, counts by partition, and each row's place in its own."""
    rows = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n_", F.monotonically_increasing_id()))
    part = F.shiftright("n_", 33)
    sizes = rows.groupBy(part.alias("part_")).agg(F.count("*").alias("size_"), F.min("n_").alias("first_"))
    # a row for each partition
    before = F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("part_", (before - F.col("first_") + 1).alias("shift_"))
    return rows.withColumn("part_", part).join(F.broadcast(shift), "part_").withColumn("k", F.col("n_") + F.col("shift_")).drop("n_", "part_", "shift_")


def append_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes whose id is not there yet, after the others, by ``ord``, then id."""
    last = nodes.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    fresh = numbered(new.join(nodes.select("id"), "id", "left_anti"), "ord", "id")
    return nodes.unionByName(fresh.crossJoin(F.broadcast(last)).withColumn("ord", F.col("last") + F.col("k")).drop("k", "last"), allowMissingColumns=True)


def append_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes that are not there yet, in any order of the new ones' own."""
    ids = nodes.select("id").distinct()
    known = new.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return edges.unionByName(known.join(edges, ["source", "target", "type"], "left_anti"), allowMissingColumns=True)


def create_task(nodes: DataFrame, task_id: str, text: str, target: str | None, now: str) -> tuple[DataFrame, DataFrame]:
    """The new task node (label of at most 72 characters) and its ``targets`` edge, if it has a target; the id is given."""
    spark, text = nodes.sparkSession, text.strip()
    label = text if len(text) <= 72 else text[:71] + "…"
    node = spark.createDataFrame([(task_id, "task", label, label, text, "user", "AUTO", "active", now)], "id string, type string, title string, label string, content string, source string, mode string, status string, created_at string")
    edge = spark.createDataFrame([(task_id, target, "targets", "AUTO")] if target else [], "source string, target string, type string, mode string")
    return node, edge

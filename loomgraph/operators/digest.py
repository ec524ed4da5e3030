"""Digests of tables (survey rows R9, G6): a tree of hashes over ranges of hashed keys.

A row belongs to the range that the first hexadecimal digits of its key's hash name. A range's digest is made of its rows' hashes in
order, the digest of a node of its sixteen children, so the root depends on the rows only, not on their order or partitioning, and
an update makes the digests of the ranges of changed keys anew, and of what is above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of the lowest ranges: 65 536 of them.
DEPTH = 4


def framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(F.concat(*[framed(F.col(c)) for c in columns]), 256)


def range_digests(df: DataFrame, key: list[str], columns: list[str], depth: int = DEPTH) -> DataFrame:
    """``node, n, digest`` of the ranges. Equal rows are counted before they meet, so copies are one entry of their range."""
    rows = df.select(F.substring(row_hash(df, key), 1, depth).alias("node"), row_hash(df, columns).alias("h")).groupBy("node", "h").agg(F.count("*").alias("n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "n"))), lambda x: F.concat(x["h"], F.lit("*"), x["n"].cast("string"))), ",")
    return rows.groupBy("node").agg(F.sum("n").alias("n"), F.sha2(said, 256).alias("digest"))


def tree_digests(ranges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``node, n, digest`` of all nodes above the ranges too; the root's name is empty."""
    out = level = ranges
    for k in range(depth - 1, -1, -1):
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"], F.lit("="), x["digest"])), ",")
        level = level.groupBy(F.substring("node", 1, k).alias("up")).agg(F.sum("n").alias("n"), F.sha2(said, 256).alias("digest")).withColumnRenamed("up", "node")
        out = out.unionByName(level)
    return out


def updated_ranges(ranges: DataFrame, df: DataFrame, changed: DataFrame, key: list[str], columns: list[str], depth: int = DEPTH) -> DataFrame:
    """The ranges after a change: those of the keys in ``changed`` from the rows that ``df`` now has, others as they were."""
    touched = changed.select(F.substring(row_hash(changed, key), 1, depth).alias("node")).distinct()
    mine = df.withColumn("node_", F.substring(row_hash(df, key), 1, depth)).join(touched.withColumnRenamed("node", "node_"), "node_", "left_semi").drop("node_")
    return ranges.join(touched, "node", "left_anti").unionByName(range_digests(mine, key, columns, depth))


def revision(modules: DataFrame, edges: DataFrame, stale: DataFrame) -> DataFrame:
    """``revision, invalidated`` of a graph's cache: one digest of modules (``id, path``) and edges (``source, target, type``), and the nodes that went stale."""
    root = lambda df, key: tree_digests(range_digests(df, key, sorted(df.columns))).where("node = ''").select("digest")
    both = root(modules, ["id"]).select(F.lit(0).alias("k"), "digest").unionByName(root(edges, ["source", "target", "type"]).select(F.lit(1).alias("k"), "digest"))
    gone = stale.agg(F.array_sort(F.collect_set("id")).alias("invalidated"))
    one = both.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "digest"))), lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["digest"])), "|"), 256).alias("revision"))
    return one.join(gone)  # one row each

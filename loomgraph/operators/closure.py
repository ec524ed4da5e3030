"""Closures over edges: bounded and unbounded reachability, by joins level by level."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTLED = 8


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a checkpoint: its plan ends there, nothing stays in memory, and lost executors lose nothing."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rows of ids and names up to which a side is broadcast, so that the other, long one is not shuffled.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """``df`` computed once, and broadcast if it is counted to be small."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for what is long: packed by columns it is a fraction of a checkpoint, and what was shuffled
    to make it goes at once."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.orc(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).orc(path)


def reach(edges: DataFrame, seeds: DataFrame, max_levels: int | None = None) -> DataFrame:
    """``id, depth``: everything reachable from the seeds (``id``) along ``source -> target``, seeds at depth 0, each at its least depth.

    A level is one join of the last frontier; what was seen is left out by an anti join, so cycles end. All levels are gone through
    unless ``max_levels`` says how many. Each level is cut from the plan before it, every ``SETTLED`` levels what was seen is too.
    """
    step = settle(edges.select("source", F.col("target").alias("id")).distinct())
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier, depth = seen, 0
    while max_levels is None or depth < max_levels:
        depth += 1
        found = frontier.select(F.col("id").alias("source")).join(step, "source").select("id").distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        found = settle(found)
        if found.isEmpty():
            break
        seen, frontier = seen.unionByName(found), found
        if depth % SETTLED == 0:
            seen = settle(seen)
    return seen


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one machine takes a folder of its own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        path = tempfile.mkdtemp(prefix="loomgraph-")
    return path.rstrip("/")

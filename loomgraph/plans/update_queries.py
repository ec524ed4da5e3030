"""Incremental update of versioned fact tables: order lines as facts of their order's file, some also of a part's file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.closure import shared_folder
from ..sources.fact_store import FactStore
from .projections import read
from .registry import query

# The files of the second batch: analysed anew, or gone.
_SCOPE = "(k % 50 = 7)"
_GONE = "(k % 97 = 5 AND k % 50 <> 7)"
_SQL = f"""WITH l AS (SELECT l_orderkey AS k, 'o' || l_orderkey AS f0, CASE WHEN l_linenumber = 1 THEN 'p' || (l_partkey % 40) END AS f1, 'part:' || l_partkey AS target, 's' || (l_partkey % 100) AS id, 'CALL' AS type FROM lineitem),
kept AS (SELECT f0, f1, target, id, type FROM l WHERE NOT {_SCOPE} AND NOT {_GONE} AND coalesce(f1, '') <> 'p3'), new AS (SELECT f0, CAST(NULL AS VARCHAR) AS f1, target, 'n' || id AS id, 'USE' AS type FROM l WHERE {_SCOPE}), now AS (SELECT * FROM kept UNION ALL SELECT * FROM new)"""


def _facts(spark, sf):
    line = read(spark, sf, "lineitem")
    part = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")))
    return line.select(F.col("l_orderkey").alias("k"), F.array_compact(F.array(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), part)).alias("files"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"), F.array(F.concat(F.lit("s"), (F.col("l_partkey") % 100).cast("string"))).alias("ids"), F.lit("CALL").alias("type"))


def _updated(spark, sf):
    store = FactStore(spark, f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}", 16)
    facts = _facts(spark, sf)
    all_files = facts.select(F.explode("files").alias("file")).distinct()
    first = store.update(1, {"relationships": facts.drop("k")}, all_files.withColumn("hash", F.lit("a")), full=True)
    some = facts.where(_SCOPE)
    again = some.select(F.slice("files", 1, 1).alias("files"), "target", F.transform("ids", lambda i: F.concat(F.lit("n"), i)).alias("ids"), F.lit("USE").alias("type"))
    states = some.select(F.col("files")[0].alias("file")).distinct().withColumn("hash", F.lit("b")).unionByName(spark.range(1).select(F.lit("p3").alias("file"), F.lit("a").alias("hash")))
    gone = facts.where(_GONE).select(F.col("files")[0].alias("file")).distinct()
    return store, first, store.update(2, {"relationships": again}, states, gone)


@query(_SQL + " SELECT f0 AS file, type, count(*) AS n, count(DISTINCT target) AS n_targets, CAST(count(f1) AS BIGINT) AS n_shared, max(id) AS id FROM now GROUP BY 1, 2")
def incremental_update(spark, sf):
    rows = _updated(spark, sf)[0].read("relationships")
    return rows.groupBy(F.col("files")[0].alias("file"), "type").agg(F.count("*").alias("n"), F.count_distinct("target").alias("n_targets"), F.sum((F.size("files") > 1).cast("bigint")).alias("n_shared"), F.max(F.col("ids")[0]).alias("id"))


@query(_SQL + f""" SELECT f0 AS file, CASE WHEN {_SCOPE} THEN 'changed' ELSE 'deleted' END AS change, array_to_string(list_sort(list_distinct(list_concat(list(id), CASE WHEN {_SCOPE} THEN list('n' || id) ELSE [] END))), ',') AS ids FROM l WHERE {_SCOPE} OR {_GONE} GROUP BY f0, k""")
def incremental_changes(spark, sf):
    return _updated(spark, sf)[2].select("file", "change", F.array_join("ids", ",").alias("ids"))


@query(_SQL + " SELECT f0, f1, target, type FROM now WHERE f0 IN ('o7', 'o32', 'o57') OR f1 IN ('p5', 'p6')")
def facts_of_files(spark, sf):
    rows = _updated(spark, sf)[0].facts_of("relationships", ["o7", "o32", "o57", "p5", "p6"])
    return rows.select(F.col("files")[0].alias("f0"), F.try_element_at("files", F.lit(2)).alias("f1"), "target", "type")

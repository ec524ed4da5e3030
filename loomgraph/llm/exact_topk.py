"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are cut into ``m`` lists; a list holds a slice of every vector and knows partial scores only. For a block of
queries: (1) each list gives its best partial scores; the vectors found are scored exactly, and a query's k-th best is a cutoff
that is safe; (2) the cutoff over ``m`` is broadcast and each list gives all vectors that reach it: a sum of ``m`` parts that reaches
the cutoff has a part that does, whatever the signs; (3) what was given is scored exactly and ranked.

Blocks of queries hold so many bytes, so what is collected and broadcast for one is bounded; each is held against all rows. Of equal
vectors only the ``k + 1`` with the smallest ids are looked at: no other can be among the k best of any query, nor with the query itself
left out. Equal queries are answered once.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as filled up with
zeros, so an empty one scores 0; components and scores beyond the range of long take its end; each row of a repeated id is a
candidate of its own, and a query of its own, and leaves out its own row only; null ids come last among equals and are no queries;
an empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_side, stored, table

#: Lists that a vector is cut into: with more, a smaller share of the cutoff lets more vectors pass (of 64 independent components, 1 in 90 with 2 and 1 in 7 with 4).
LISTS = 2
#: Bytes of the components of a block of queries, as 64-bit numbers.
BLOCK_BYTES = 4 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def components(vector: Column) -> Column:
    """``floor(1024 * x)`` of every component; null if the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("bigint")))


def matrix(column, width: int):
    """A list column as a matrix of 64-bit integers, short lists filled up with zeros."""
    import numpy as np

    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    ends = ends - ends[0]
    if len(values) == len(column) * width:
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        out[k, : b - a] = values[a:b]
    return out


def products(a, b):
    """All inner products of the rows of two integer matrices, exactly: as doubles where no sum can be rounded, else as integers of any size."""
    import numpy as np

    def largest(x):
        return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0

    if largest(a) * largest(b) * max(a.shape[1], 1) < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(object) @ b.astype(object).T


def as_long(scores):
    import numpy as np

    return np.array([min(max(int(x), LEAST), MOST) for x in scores], np.int64) if scores.dtype == object else scores.astype(np.int64)


def best_of_list(queries, width: int, k: int):
    """Phase 1: ``qid, row, part``, the best ``k`` partial scores that a task meets, for each query of the block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, block = queries.value
        best: dict = {}
        for batch in batches:
            at, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = matrix(batch.column(2), width)
            for which in np.unique(at):
                mine = at == which
                part, rows = products(block[:, which * width : (which + 1) * width], values[mine]), np.broadcast_to(row[mine], (len(ids), mine.sum()))
                if which in best:
                    part, rows = np.concatenate([best[which][0], part], 1), np.concatenate([best[which][1], rows], 1)
                if part.shape[1] > k:
                    top = np.argpartition(-part, k - 1, axis=1)[:, :k] if part.dtype != object else np.argsort(-part, axis=1)[:, :k]
                    part, rows = np.take_along_axis(part, top, 1), np.take_along_axis(rows, top, 1)
                best[which] = part, rows
        for which, (part, rows) in best.items():
            n = part.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.full(rows.size, which, np.int32)), pa.array(rows.ravel()), pa.array(as_long(part.ravel()))], names=["qid", "list", "row", "part"])

    return run


def over_cutoff(queries, cutoffs, width: int):
    """Phase 2: ``qid, row`` whose partial score reaches the query's cutoff."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, block = queries.value
        cut = np.array(cutoffs.value, object)
        for batch in batches:
            at, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = matrix(batch.column(2), width)
            for which in np.unique(at):
                mine = at == which
                part = products(block[:, which * width : (which + 1) * width], values[mine])
                # integers under 2**53 are exact as doubles; a cutoff beyond them is beyond every such part
                reach = part >= (cut if part.dtype == object else cut.astype(np.float64))[:, None]
                q, r = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(row[mine][r])], names=["qid", "row"])

    return run


def exact_scores(queries, width: int):
    """Phase 3: ``qid, row, vec_id, score`` of pairs with the vector beside them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, block = queries.value
        place = {q: k for k, q in enumerate(ids.tolist())}
        for batch in batches:
            q = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            a, b = block[q], matrix(batch.column(3), width)
            if products_fit(a, b):
                score = np.einsum("ij,ij->i", a, b)
            else:
                score = as_long((a.astype(object) * b.astype(object)).sum(axis=1).astype(object))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(score, pa.int64())], names=["qid", "row", "vec_id", "score"])

    def products_fit(a, b):
        bound = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (a, b)]
        return bound[0] * bound[1] * max(a.shape[1], 1) < 1 << 62

    return run


def top_products(vectors: DataFrame, asks: Column, k: int = 10, lists: int = LISTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``vec_id, embedding``: for each row with ``asks``, its ``k`` best other rows."""
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), components(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("asks", F.coalesce(asks, F.lit(False))), "vectors")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    width = -(-dims // lists)

    same = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "row")
    kept = stored(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).select("row", "vec_id", "v"), "kept")
    cuts = [F.struct(F.lit(i).alias("list"), F.slice("v", i * width + 1, width).alias("part")) for i in range(lists)]
    parts = stored(kept.select("row", F.explode(F.array(*cuts)).alias("p")).select("p.list", "row", "p.part"), "lists")

    asked = rows.where("asks")
    blocks = max(1, -(-asked.count() * dims * 8 // block_bytes))
    classes = stored(asked.select("v").distinct().withColumn("qid", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")), "queries")
    found = None
    for b in range(blocks):
        one = block_of_queries(spark, classes.where(F.col("block") == b), kept, parts, k + 1, lists, width)
        found = one if found is None else found.unionByName(one)
    # each asking row takes its class's k + 1 best without itself
    own = asked.select("row", F.col("vec_id").alias("query_id"), "v").join(small_side(classes.select("v", "qid"), 10_000_000 // (8 * dims + 64)), "v").select("qid", "row", "query_id")
    best = own.join(found, "qid").withColumn("best", F.slice(F.filter("best", lambda x: x["row"] != F.col("row")), 1, k))
    return best.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")


def block_of_queries(spark: SparkSession, classes: DataFrame, kept: DataFrame, parts: DataFrame, k: int, lists: int, width: int) -> DataFrame:
    """``qid, best``: the ``k`` best rows of each query of one block, in order."""
    import numpy as np

    got = classes.select("qid", "v").toArrow()
    ids = got.column("qid").to_numpy()
    block = matrix(got.column("v").combine_chunks(), width * lists) if got.num_rows else np.zeros((0, width * lists), np.int64)
    queries = spark.sparkContext.broadcast((ids, block))

    def resolved(pairs):
        return pairs.join(kept, "row").select("qid", "row", "vec_id", "v").mapInArrow(exact_scores(queries, width * lists), "qid bigint, row bigint, vec_id bigint, score bigint")

    by_part = Window.partitionBy("qid", "list").orderBy(F.desc("part"), "row")
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    near = parts.mapInArrow(best_of_list(queries, width, k), "qid bigint, list int, row bigint, part bigint")
    near = near.withColumn("nth", F.row_number().over(by_part)).where(F.col("nth") <= k).select("qid", "row").distinct()
    kth = {r["qid"]: r["score"] for r in resolved(near).withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == k).select("qid", "score").collect()}
    cutoffs = spark.sparkContext.broadcast([-(-kth[q] // lists) if kth.get(q, LEAST) > LEAST else LEAST * (1 << 70) for q in ids.tolist()])

    reached = parts.mapInArrow(over_cutoff(queries, cutoffs, width), "qid bigint, row bigint").distinct()
    best = resolved(reached).withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k)
    best = best.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "row", "vec_id", "score"))), lambda x: F.struct(x["row"], x["vec_id"], x["score"])).alias("best"))
    best = stored(best, "best")
    cutoffs.unpersist()
    queries.unpersist()
    return best


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row of ``embeddings`` whose id is divisible by 100, the ten rows with the highest integer inner product."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, c.r AS cr, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10"""

"""Ranked lexical search over term-bucketed postings.

Postings are rows ``bucket, term, rows, counts``: the documents of one Arrow batch that hold a term, and how often each does. They
lie in one folder a bucket of terms, so a search reads only the buckets of the terms it asks for. A frequent term has a posting row
for each batch that holds it, so no row grows with the corpus, and Spark splits a bucket with such a term into more files. The row of
bucket -1 has a batch's documents and their lengths. A search joins the items' terms, gives each match its integer score, groups by
item and document, and numbers the sums in a window.

Defined cases: a null text has no term, and a document without one is not counted; every row of ``documents`` is a document of its
own, also if ids or whole rows repeat (such rows are ranked one after the other); a null id is ranked last among equals; rows of the
same ``item_id`` are one item with the terms of all; an item that matches nothing has no row; empty tables give an empty result.
Only the columns named here are read, so others may bear any name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, sliced, small_side, stored, table

#: Characters between terms, as in the search's contract.
BETWEEN = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents for each bucket of terms, and the bounds of the number of buckets.
DOCUMENTS_A_BUCKET, BUCKETS = 20_000, (4, 4096)
SCHEMA = "bucket int, term string, rows array<bigint>, counts array<int>, ids array<bigint>"


@dataclass
class Postings:
    """Where the postings are, their number of buckets, documents with a term, and terms with repeats."""

    path: str
    buckets: int
    documents: int
    terms: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.path)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def inverted(buckets: int):
    """Arrow batches ``row, doc_id, text`` to posting rows."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # every byte of a character beyond ASCII belongs to a term
        fold = bytearray(range(256))
        for lo, hi in BETWEEN:
            fold[lo : hi + 1] = b" " * (hi + 1 - lo)
        fold[0x41:0x5B] = range(0x61, 0x7B)
        fold = bytes(fold)

        def lists(values, starts, kind):
            return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))

        for batch in sliced(batches):
            row, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            words, lengths = [], np.zeros(len(row), np.int64)
            for k, text in enumerate(batch.column(2)):
                found = (text.as_py() or b"").translate(fold).split()
                lengths[k] = len(found)
                words += found
            held = np.flatnonzero(lengths)
            if not len(held):
                continue
            whole = pa.RecordBatch.from_arrays(
                [pa.array([-1], pa.int32()), pa.array([None], pa.string()), lists(row[held], [0], pa.int64()), lists(lengths[held], [0], pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), ids.take(pa.array(held)))], names=["bucket", "term", "rows", "counts", "ids"])
            coded = pa.array(words, pa.binary()).dictionary_encode()
            del words
            keys, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * len(row) + np.repeat(np.arange(len(row)), lengths), return_counts=True)
            code, place = keys // len(row), keys % len(row)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            terms = coded.dictionary.take(pa.array(code[starts]))
            bucket = np.fromiter((zlib.crc32(t) % buckets for t in terms.to_pylist()), np.int32, len(terms))
            yield whole
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pc.cast(terms, pa.string()), lists(row[place], starts, pa.int64()), lists(counts, starts, pa.int32()), pa.nulls(len(terms), pa.list_(pa.int64()))],
                names=["bucket", "term", "rows", "counts", "ids"],
            )

    return run


def build_postings(docs: DataFrame, buckets: int | None = None) -> Postings:
    """Index ``doc_id, text``: every term of every document, in one pass over the texts.

    ``docs`` should come from a table or a checkpoint: a row's number is its place in the scan. ``buckets`` grows with the documents.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = min(max(BUCKETS[0], 1 << (docs.count() // DOCUMENTS_A_BUCKET).bit_length()), BUCKETS[1])
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    made = rows.mapInArrow(inverted(buckets), SCHEMA)
    # a bucket with a frequent term is dealt to several tasks
    made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    read = spark.read.schema(SCHEMA).parquet(path).where("bucket = -1")
    total = read.agg(F.sum(F.size("rows")).alias("n"), F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("l")).first()
    return Postings(path, buckets, total["n"] or 0, total["l"] or 0)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``, once each."""
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(PATTERN), F.lit(0)))).alias("term")).distinct()


def ranked(index: Postings, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents, equal scores by smaller id."""
    spark = items.sparkSession
    n, total = index.documents, index.terms
    asked = stored(item_terms(items), "item-terms")
    terms = stored(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "terms")
    asked = stored(asked.join(small_side(terms), "term").select("item_id", "tid"), "asked")
    # which buckets are read: of the terms, if they are not more than the buckets anyway
    postings = index.read(spark)
    wanted = terms.select(bucket_of(F.col("term"), index.buckets).alias("b")).distinct()
    part = [r["b"] for r in wanted.limit(index.buckets).collect()]
    found = postings.where(F.col("bucket").isin(part)).join(small_side(terms), "term").select("tid", "rows", "counts")
    weights = found.groupBy("tid").agg(F.sum(F.size("rows")).alias("df"))
    weights = stored(weights.select("tid", F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("bigint").alias("w")), "weights")

    # all terms of a document meet in one partition, so the sums below need no other shuffle
    pairs = F.explode(F.arrays_zip("rows", "counts")).alias("p")
    hits = found.select("tid", pairs).select("tid", F.col("p.rows").alias("row"), F.col("p.counts").alias("tf")).repartition("row")
    each = F.explode(F.arrays_zip("rows", "counts", "ids")).alias("p")
    lengths = postings.where("bucket = -1").select(each).select(F.col("p.rows").alias("row"), F.col("p.ids").alias("doc_id"), F.expr(f"100 - 90 + ((90L * p.counts * {n}L) div {max(total, 1)}L)").alias("m"))
    scored = hits.join(lengths.repartition("row").hint("shuffle_hash"), "row").join(small_side(weights), "tid")
    scored = scored.select("row", "doc_id", "tid", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("s")).where("s > 0")
    sums = scored.join(small_side(asked), "tid").groupBy("row", "item_id", "doc_id").agg(F.sum("s").alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` ranked for each ``benchmark`` item."""
    return ranked(build_postings(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
n AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT item_id, p.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total))))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN n ON n.r = p.r, c GROUP BY item_id, p.r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""

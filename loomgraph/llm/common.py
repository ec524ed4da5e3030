"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of a batch that is sent to a Python worker; texts may be long, and every task holds a batch in the JVM and one in Python.
BATCH_BYTES = 2 << 20


def lean(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, whatever the number of their rows, and column chunks out of buffers outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, A_Z, a_z)


def utf8(name: str) -> Column:
    """A text column as bytes; null is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and there is
    one machine only (tests); a cluster must name one."""
    lean(spark)
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        path = tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(path)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and lost executors lose nothing.

    What was shuffled to make it is not needed any more and goes at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a stored table of narrow rows (under 100 bytes each) is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def sliced(batches, rows: int = 1000):
    """Arrow batches in slices of so many rows, so that what a worker makes of one stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


class WordHashes:
    """64-bit hashes of words; ``fold`` maps a text's bytes so that words are parted by spaces.

    No words are kept: looking one up takes longer than its hash, and their number grows with the texts.
    """

    def __init__(self, fold):
        import xxhash

        self.hash, self.fold = xxhash.xxh64_intdigest, fold

    def of(self, data: bytes):
        import numpy as np

        words = self.fold(data).split()
        return np.fromiter(map(self.hash, words), np.uint64, len(words))


def word_grams(words, n: int):
    """A 64-bit hash of every n word hashes in a row; ``words`` has n at least."""
    import numpy as np

    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Return freed memory of a Python worker to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def per_process(name: str, make):
    """A value made once in a Python worker and kept from task to task; only the last one asked for is kept.

    What the one before it held is given back to the system, not to this process only.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_loomgraph_worker", types.ModuleType("_loomgraph_worker"))
    if getattr(kept, "name", None) != name:
        kept.value = None
        give_back()
        kept.name, kept.value = name, make()
    return kept.value

"""Versioned fact tables with incremental updates (survey rows I8, I9, I10, I12).

A row of a table belongs to files (``files``: its path, or those of its evidence) and lies in the bucket of the first of them. An update
of some files rewrites the buckets that hold rows of these files and no others: a look-up table, bucketed by file, says which. A version
is a manifest that names, for each bucket, the version that wrote it; it is written last and in one piece, so readers see the old
version or the new one, and an update that stopped half-way or runs again gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.closure import settle

LOOKUP, STATE = "lookup", "state"
SHAPES = {LOOKUP: "files array<string>, tbl string, home int", STATE: "files array<string>, hash string, ids array<string>"}
MANIFEST = "tbl string, bucket int, written bigint, shape string"


@dataclass
class FactStore:
    """A store in a folder that driver and executors share; ``buckets`` is fixed when it is made."""

    spark: SparkSession
    root: str
    buckets: int = 32

    def bucket(self, file: Column) -> Column:
        return F.pmod(F.crc32(file.cast("binary")), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        try:
            rows = self.spark.read.schema(f"{MANIFEST}, n bigint").parquet(f"{self.root}/commits").select("n").distinct().collect()
        except Exception as e:  # nothing was committed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted(r.n for r in rows)

    def manifest(self, version: int | None = None) -> dict[tuple[str, int], tuple[int, str]]:
        """(table, bucket) -> (version that wrote it, the table's shape). It has a row a table and bucket, whatever the data."""
        known = self.versions()
        version = max(known, default=None) if version is None else version
        if version is None or version not in known:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/commits/n={version}").collect()
        return {(r.tbl, r.bucket): (r.written, r.shape) for r in rows}

    def read(self, table: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or the given buckets of it, at a version (else the last)."""
        return self._rows(table, self.manifest(version), buckets)

    def _rows(self, table: str, manifest: dict, buckets: list[int] | None = None, shape: str | None = None) -> DataFrame:
        held = {b: at for (t, b), at in manifest.items() if t == table and (buckets is None or b in set(buckets))}
        shape = shape or next((s for (t, _), (_, s) in manifest.items() if t == table), SHAPES.get(table))
        if shape is None:
            raise KeyError(f"no such table: {table}")
        paths = [f"{self.root}/data/v{written}/{table}/bucket={b}" for b, (written, _) in sorted(held.items()) if written >= 0]
        return self.spark.read.schema(shape).parquet(*paths) if paths else self.spark.createDataFrame([], shape)

    def facts_of(self, table: str, files: list[str], version: int | None = None) -> DataFrame:
        """I8: rows that belong to any of the files; only buckets that hold some are read."""
        manifest = self.manifest(version)
        scope = self.spark.createDataFrame([(f,) for f in files], "file string")
        homes = self._homes(scope, manifest).get(table, set())
        return self._rows(table, manifest, sorted(homes)).where(F.arrays_overlap("files", F.array(*[F.lit(f) for f in files])))

    def _homes(self, scope: DataFrame, manifest: dict) -> dict[str, set[int]]:
        """table -> buckets with rows of the files in ``scope``."""
        own = [r.b for r in scope.select(self.bucket(F.col("file")).alias("b")).distinct().collect()]
        rows = self._rows(LOOKUP, manifest, own).select(F.col("files")[0].alias("file"), "tbl", "home").join(scope, "file", "left_semi")
        out: dict[str, set[int]] = {}
        for r in rows.select("tbl", "home").distinct().collect():
            out.setdefault(r.tbl, set()).add(r.home)
        return out

    def update(self, version: int, facts: dict[str, DataFrame], states: DataFrame, deleted: DataFrame | None = None, full: bool = False) -> DataFrame:
        """Merge the facts of the files in ``states`` (``file, hash``) into the last version and make ``version`` of it.

        facts: table -> rows with ``files`` and, for invalidation, ``ids``; deleted: ``file``. ``full`` starts from nothing. Gives the
        differences ``file, change, ids``: what changed or went, with the ids that it had before and has now. A version that is
        there already is left as it is.
        """
        known = self.versions()
        older = [v for v in known if v < version]
        before = {} if full or not older else self.manifest(older[-1])
        if version in known:
            return self._changes(before, self.manifest(version), states, deleted, full)
        gone = deleted.select("file") if deleted is not None else states.select("file").where("false")
        scope = settle(states.select("file").unionByName(gone).distinct())
        homes = self._homes(scope, before)
        manifest = dict(before)
        settled = {name: settle(df) for name, df in facts.items()}
        for name, new in settled.items():
            self._merge(name, new, scope, homes.get(name, set()), manifest, version)
        # the look-up of the files that have or had rows in the rewritten buckets
        moved = stale = None
        for name in settled:
            rewritten = [b for (t, b), at in manifest.items() if t == name and at != before.get((t, b))]
            now, then = (self._places(name, m, rewritten, manifest) for m in (manifest, before))
            moved, stale = (now, then) if moved is None else (moved.unionByName(now), stale.unionByName(then))
        self._relook(moved, stale, before, manifest, version)
        ids = None
        for new in settled.values():
            one = new.select(F.explode("files").alias("file"), F.explode("ids").alias("id")) if "ids" in new.columns else None
            ids = one if ids is None else ids if one is None else ids.unionByName(one)
        states = states.select("file", "hash").groupBy("file").agg(F.max("hash").alias("hash"))
        none = F.array().cast("array<string>")
        held = ids.groupBy("file").agg(F.array_sort(F.collect_set("id")).alias("ids")) if ids is not None else states.select("file", none.alias("ids")).where("false")
        new = states.join(held, "file", "left").select(F.array("file").alias("files"), "hash", F.coalesce("ids", none).alias("ids"))
        own = {r.b for r in scope.select(self.bucket(F.col("file")).alias("b")).distinct().collect()}
        self._merge(STATE, settle(new), scope, own, manifest, version)
        rows = [(t, b, w, s) for (t, b), (w, s) in manifest.items()]
        # the commit: one file of one task
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/n={version}")
        return self._changes(before, self.manifest(version), states, deleted, full)

    def _merge(self, name: str, new: DataFrame, scope: DataFrame, homes: set[int], manifest: dict, version: int) -> None:
        """Write the buckets of a table that lose or gain rows."""
        touched = sorted(homes | {r.b for r in new.select(self.bucket(F.col("files")[0]).alias("b")).distinct().collect()})
        held = any(t == name for t, _ in manifest)
        old = self._rows(name, manifest, touched) if held else new.where("false")
        rows = _without_files(old, scope).unionByName(new)
        self._write(name, rows, touched, manifest, version)

    def _write(self, name: str, rows: DataFrame, touched: list[int], manifest: dict, version: int) -> None:
        path = f"{self.root}/data/v{version}/{name}"
        keyed = rows.withColumn("bucket", self.bucket(F.col("files")[0]))
        keyed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        wrote = {r.bucket for r in self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path).select("bucket").distinct().collect()}
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        for b in touched:
            manifest[name, b] = (version if b in wrote else -1, shape)
        if not touched:
            manifest.setdefault((name, 0), (-1, shape))

    def _places(self, name: str, at: dict, buckets: list[int], shapes: dict) -> DataFrame:
        """``file, tbl, home`` of the rows that some buckets of a table have in a manifest."""
        shape = next(s for (t, _), (_, s) in shapes.items() if t == name)
        rows = self._rows(name, at, buckets, shape)
        return rows.select(F.explode("files").alias("file"), F.lit(name).alias("tbl"), self.bucket(F.col("files")[0]).alias("home")).distinct()

    def _relook(self, moved: DataFrame, stale: DataFrame, before: dict, manifest: dict, version: int) -> None:
        """Look-up rows (``file, tbl, home``) that were so and are so no more give way to those that are so now."""
        moved, stale = settle(moved), settle(stale)
        touched = sorted(r.b for r in moved.select("file").unionByName(stale.select("file")).select(self.bucket(F.col("file")).alias("b")).distinct().collect())
        old = self._rows(LOOKUP, before, touched).select(F.col("files")[0].alias("file"), "tbl", "home")
        rows = old.join(stale, ["file", "tbl", "home"], "left_anti").unionByName(moved)
        self._write(LOOKUP, rows.select(F.array("file").alias("files"), "tbl", "home"), touched, manifest, version)

    def _changes(self, before: dict, after: dict, states: DataFrame, deleted: DataFrame | None, full: bool) -> DataFrame:
        scope = states.select("file")
        if deleted is not None:
            scope = scope.unionByName(deleted.select("file"))
        buckets = None if full else sorted({r.b for r in scope.select(self.bucket(F.col("file")).alias("b")).distinct().collect()})
        side = lambda m, h, i: self._rows(STATE, m, buckets).select(F.col("files")[0].alias("file"), F.col("hash").alias(h), F.col("ids").alias(i))
        both = side(before, "old", "old_ids").join(side(after, "new", "new_ids"), "file", "full_outer")
        change = F.when(F.col("new").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
        none = F.array().cast("array<string>")
        out = both.select("file", change.alias("change"), F.array_sort(F.array_union(F.coalesce("old_ids", none), F.coalesce("new_ids", none))).alias("ids"))
        return out.where("change <> 'unchanged'")


def _without_files(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows that belong to none of the files. The first file of a row is joined as it is; what rows of several files hold is hashed, so
    that those of them whose other files are in the scope are found by an equi-join."""
    left = rows.withColumn("file_", F.col("files")[0]).join(scope.select(F.col("file").alias("file_")), "file_", "left_anti").drop("file_")
    several = F.size("files") > 1
    keyed = left.where(several).withColumn("key_", F.sha2(F.to_json(F.struct("*")), 256))
    doomed = keyed.select("key_", F.explode(F.slice("files", F.lit(2), F.size("files"))).alias("file")).join(scope, "file", "left_semi").select("key_")
    return left.where(~several).unionByName(keyed.join(doomed, "key_", "left_anti").drop("key_"))


def watch_files(spark: SparkSession, folder: str, schema: str, store: FactStore, analyse, checkpoint: str, trigger: dict | None = None):
    """A query over rows of changed files (``file, hash`` and what ``analyse`` needs; a null hash: the file is gone) in a folder.

    Each micro-batch is one update, its number the version, so a batch that runs again changes nothing. ``analyse(rows)`` gives the facts.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = settle(rows)
        there = rows.where("hash IS NOT NULL")
        store.update(number + 1, analyse(there), there.select("file", "hash"), rows.where("hash IS NULL").select("file"))

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

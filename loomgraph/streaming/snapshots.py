"""Optional streaming ingestion: file-state rows from a folder, each micro-batch compared with the last snapshot (survey 7.6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.index import snapshot_diff

STATE = "file string, hash string"


def watch_snapshots(spark: SparkSession, folder: str, checkpoint: str, on_change: Callable[[DataFrame, int], None], trigger: dict | None = None):
    """Start a query over Parquet snapshots (``file, hash``) in a folder; ``on_change`` gets each batch's differences from the state
    before it, which is kept as a table below the checkpoint, one version a batch, so a batch that runs again gives the same."""

    def state(version: int) -> DataFrame:
        path = f"{checkpoint}/state/v{version}"
        try:
            return spark.read.schema(STATE).parquet(path)
        except Exception as e:  # a first batch has no state before it
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], STATE)

    def batch(rows: DataFrame, number: int) -> None:
        before = state(number - 1)
        now = rows.select("file", "hash").dropDuplicates(["file"])
        on_change(snapshot_diff(before, now), number)
        now.write.mode("overwrite").parquet(f"{checkpoint}/state/v{number}")

    stream = spark.readStream.schema(STATE).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/query").trigger(**(trigger or {"availableNow": True})).start()

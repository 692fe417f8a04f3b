"""Keeping tables current from streams: upserts by key with versions on disk, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.catalog import latest


def versions(rows_like: DataFrame, root: str) -> list[int]:
    """Batch ids of the whole versions below a folder, in order: those whose write has ended."""
    jvm = rows_like.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(rows_like.sparkSession._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(like: DataFrame, root: str, before: int | None = None) -> DataFrame:
    """The latest version of a table below a folder (of those before a batch, if given), with like's columns; empty without one."""
    found = [v for v in versions(like, root) if before is None or v < before]
    spark = like.sparkSession
    return spark.read.schema(like.schema).parquet(f"{root}/batch={found[-1]}") if found else spark.createDataFrame([], like.schema)


def upsert(batch: DataFrame, batch_id: int, root: str, keys: list[str], order_col: str) -> None:
    """Writes a version of the table with the rows of a batch: of each key the row with the largest order_col, whether it came with this batch or before.

    The version is named by the batch, so the latest is found again after a restart, and a batch that is run again
    starts from the version before it and writes the same rows.
    """
    merged = latest(current(batch, root, batch_id).unionByName(batch), keys, [F.desc(order_col)])
    merged.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")


def maintain(updates: DataFrame, root: str, keys: list[str], checkpoint: str, order_col: str) -> StreamingQuery:
    """Apply a stream of updates to the table below root, a micro-batch at a time."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, batch_id, root, keys, order_col)

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and time window; events later than `lateness` are left out of a stream."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

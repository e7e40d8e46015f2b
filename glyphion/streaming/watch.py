"""Watching a folder of change events, and re-indexing what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, schema, gap: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Bursts of change events (ts, file, kind) of each file: a stream of file, first_at, last_at, n and the last kind.

    A burst ends when its file was quiet for `gap`; the watermark bounds how long it is kept.
    """
    events = spark.readStream.schema(schema).parquet(path).withWatermark("ts", late)
    bursts = events.groupBy(F.session_window("ts", gap), "file").agg(F.count("*").alias("n"), F.max_by("kind", "ts").alias("kind"), F.max("ts").alias("last_at"))
    return bursts.select("file", F.col("session_window.start").alias("first_at"), "last_at", "n", "kind")


def reindex(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of changes to `update`, once a batch."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(update).start()


def apply_changes(held: dict[str, DataFrame], changed: DataFrame, read: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """All tables of an index (project, file, ...) after a batch of changes (project, file, kind).

    Rows of every file of the batch go from all tables; files whose last change isn't a deletion
    are read again, by `read`, which gives the new rows of each table.
    """
    files = changed.select("project", "file").distinct()
    fresh = read(changed.where("kind <> 'deleted'").select("project", "file").distinct())
    kept = {name: rows.join(files, ["project", "file"], "left_anti") for name, rows in held.items()}
    return {name: rows.unionByName(fresh[name]) if name in fresh else rows for name, rows in kept.items()}

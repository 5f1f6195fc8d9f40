"""Continuous indexing as a streaming query, and incremental merges of a change feed."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(engine, repo_path: str | Path, name: str | None = None, interval: float = 5.0, seen: Callable[[dict], None] = lambda _: None, checkpoint: str | None = None) -> StreamingQuery:
    """Index a directory again at every trigger; an error is reported and the next trigger tries again.

    The file stream source tells of new files only, so each trigger diffs a snapshot: changed and deleted files count as well.
    """
    if interval <= 0:
        raise ValueError("the interval must be positive")

    def step(_: DataFrame, batch: int) -> None:
        try:
            seen(engine.index_repo(repo_path, name))
        except Exception as e:
            print(f"watch: index pass failed: {e}", file=sys.stderr)

    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    out = ticks.writeStream.foreachBatch(step).trigger(processingTime=f"{int(interval * 1000)} milliseconds")
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def latest(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key: one aggregate, no window."""
    rest = [c for c in changes.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return changes.groupBy(*key).agg(best).select(*key, *[F.col(f"row.{c}").alias(c) for c in rest])


def merge(stored: DataFrame, changes: DataFrame, key: list[str], order: list[str], deleted: str) -> DataFrame:
    """stored with the last change of each key in place of its row; rows whose last change is a deletion go."""
    last = latest(changes, key, order)
    kept = stored.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.where(~F.col(deleted)).select(*stored.columns))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and their value by window and type; with a watermark on a stream. Batch and stream give the same rows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late and events.isStreaming else rows
    counted = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def first_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")

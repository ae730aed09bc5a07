"""Continuous ingest: a trigger that compares listings, since a file stream sees neither edits nor deletions.

Each trigger is idempotent: it lists, diffs against the head table by path, size and time, reads only
new and changed files, appends their versions, and names what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import changes
from ..sources.files import accepted
from ..sources.store import kept
from ..sources.tree import contents, walk


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime of the files that pass the name and size rules; contents are not read."""
    return walk(spark, root).filter("not folder and reason is null").select(F.col("relative_path").alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))


def ingest_once(spark: SparkSession, root: str, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions to append, states): what a trigger finds against the head table (path, size, mtime, active)."""
    found = listing(spark, root)
    states = kept(changes(found, heads), "states")
    wanted = found.join(states.filter("state in ('new', 'changed')"), "path", "left_semi")
    return accepted(contents(wanted.select(F.col("path").alias("relative_path"), F.col("size").alias("length"), F.timestamp_micros("mtime").alias("modificationTime")), root)), states


def watch(spark: SparkSession, root: str, heads: Callable[[], DataFrame], commit: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, seconds: int = 60, once: bool = False):
    """A streaming query whose batches run ``ingest_once`` and hand the outcome to ``commit``."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def tick(_, batch_id: int) -> None:
        commit(*ingest_once(spark, root, heads()), batch_id)

    writer = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(1, seconds)} seconds")).start()

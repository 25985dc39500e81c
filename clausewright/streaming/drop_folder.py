"""Analyses each document that is dropped into a folder, once per content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausewright.operators import library


def dropped(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """A stream of (path, content, content_hash, at) of new files; empty files are left out."""
    rows = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return rows.where(F.col("length") > 0).select("path", "content", library.content_hash(F.col("content")).alias("content_hash"), F.col("modificationTime").alias("at"))


def first_of_content(files: DataFrame, horizon: str = "7 days") -> DataFrame:
    """The first file of each content. State older than the horizon is given up, so it stays bounded; a copy that comes
    later is caught by the library's hashes in `analyse_each`."""
    return files.withWatermark("at", horizon).dropDuplicatesWithinWatermark(["content_hash"])


def counts_by_window(files: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, n): files per window of their time; files later than `late` are dropped by the watermark."""
    return files.withWatermark("at", late).groupBy(F.window("at", width)).agg(F.count("*").alias("n"))


def analyse_each(files: DataFrame, known: Callable[[], DataFrame | None], analyse: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that gives each batch's files of unknown content to `analyse(batch, batch_id)`.

    A batch may be given again after a failure, with the same id; `analyse` must write by that id or replace by key.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        entries = known()
        fresh = batch if entries is None else library.unseen(batch, entries)
        analyse(fresh.dropDuplicates(["content_hash"]), batch_id)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Incremental index building by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fragmatch.config import Config
from fragmatch.plans import engine
from fragmatch.plans.scratch import drop, save
from fragmatch.sources import index as store

#: The log is compacted after so many micro-batches.
COMPACT_EVERY = 50


def repeated(batch: DataFrame) -> DataFrame:
    """The ids that more than one row of ``batch`` has; a saved table."""
    return save(batch.groupBy(F.col("image_id").alias("_id")).count().where("count > 1").select("_id"))


def one_each(batch: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each id; only rows of ``ids``, those that are repeated, are exchanged and sorted with what they hold."""
    if not ids.head(1):
        return batch
    same = F.col("image_id").eqNullSafe(F.col("_id"))
    return batch.join(ids, same, "left_anti").unionByName(batch.join(ids, same, "left_semi").dropDuplicates(["image_id"]))


def ingest(images: DataFrame, path: str, checkpoint: str, config: Config, kernel=None, once: bool = True, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Add a stream of raster rows to an index, which ``index.read`` reads.

    Each micro-batch is one commit, tagged with the checkpoint and its number,
    so that a repeated attempt changes nothing. An image that comes again
    replaces what it had, whoever wrote that; of rows of one id in one batch
    one is taken. Batch writers and other streams may commit in between.
    """
    spark = images.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        ids = repeated(batch)
        store.add(engine.index(one_each(batch, ids), config, kernel), path, tag=f"{checkpoint}#{number}")
        drop(ids)
        if number % compact_every == compact_every - 1:
            store.compact(spark, path)

    writer = images.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Incremental ingest: each micro-batch is merged idempotently, so late and repeated rows need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import coalesce_merge
from ..operators.runs import MERGED, commit, tables
from ..sources.versions import current, new_version


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The observations as of their last whole batch."""
    return tables(spark, root)[0]


def merge_stream(spark: SparkSession, source: DataFrame, root: str, checkpoint: str):
    """Start a query that folds each batch into the table under root and publishes the result as its next version.

    A version is marked with its checkpoint and batch, so that a batch that is given again is not merged twice, and a
    new checkpoint goes on from the table that is there. source: the observation columns.
    """

    def merge(batch: DataFrame, number: int) -> None:
        mark, found = f"{checkpoint} {number}", current(spark, root)
        if found and found[1] == mark:
            return
        # rows keep the order in which the batch holds them
        batch = batch.withColumn("seq", F.monotonically_increasing_id())
        observations, log = tables(spark, root)
        commit(spark, new_version(root), coalesce_merge(observations, batch, "id", "seq", MERGED), log, mark)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The latest label of every (environment, uri, val) kept up by a stream (A6), without reading the log again.

The state is an aggregate over (key, period of emission): the latest id, its time and how often the label came. The watermark evicts periods that are
over, so it holds the keys of the running periods only. What changes is upserted into a stored table that is partitioned by period: a batch rewrites
the periods it touches. The current row of a key is the maximum over its few periods, read off that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import VersionedTable

SCHEMA = "environment string, uri string, val string, period string, latest_id long, latest_cts timestamp, n_emitted long"
KEYS = ["environment", "uri", "val", "period"]


def latest_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, SCHEMA, partition_col="period")


def latest_stream(log: DataFrame, period: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """From a stream of log rows the changed aggregates (update mode)."""
    window = F.window("cts", period)
    grouped = log.withWatermark("cts", watermark).groupBy("environment", "uri", "val", window.alias("w"))
    found = grouped.agg(F.max("id").alias("latest_id"), F.max_by("cts", "id").alias("latest_cts"), F.count(F.lit(1)).alias("n_emitted"))
    return found.select("environment", "uri", "val", F.date_format("w.start", "yyyy-MM-dd'T'HH-mm-ss").alias("period"), "latest_id", "latest_cts", "n_emitted")


def start_latest_stream(log: DataFrame, table: VersionedTable, checkpoint: str, period: str = "1 day", watermark: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        # a key's aggregate only grows: its count is the order of its versions
        table.merge(batch, KEYS, "n_emitted", batch=("latest", batch_id))

    writer = latest_stream(log, period, watermark).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def read_latest(table: VersionedTable) -> DataFrame:
    """environment, uri, val, latest_id, latest_cts, n_emitted: one row per key."""
    return (table.read().groupBy("environment", "uri", "val")
            .agg(F.max("latest_id").alias("latest_id"), F.max_by("latest_cts", "latest_id").alias("latest_cts"), F.sum("n_emitted").alias("n_emitted")))


def state_rows(query: StreamingQuery) -> int:
    """Rows in the query's state after its last batch."""
    progress = query.lastProgress
    return sum(op["numRowsTotal"] for op in (progress["stateOperators"] if progress else []))

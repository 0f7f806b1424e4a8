"""As-of join: to every row the latest row of the other side at or before its time.

Both sides are range-partitioned and sorted together by (key, time), so that neither a key with a third of all rows nor a burst of time lands in one
task. Inside a task the last row of the other side is carried along; what a key brings over from earlier tasks comes from a table with two rows
per task. The order is written to a table first, so that a recomputation sees the same tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, order: str | None = None,
              scratch: str | None = None) -> DataFrame:
    """The columns of ``left`` and, as a struct ``found``, the row of ``right`` with the same ``key`` (null equals null) and the greatest time at or before
    ``left_time``; null if there is none. Of rows of one time that with the greatest ``order`` counts (null is least). Rows of
    ``right`` without a time are left out; rows of ``left`` without one find nothing."""
    spark = left.sparkSession
    if left.schema[key].dataType != right.schema[key].dataType:
        raise TypeError(f"{key} differs in type: {left.schema[key].dataType.simpleString()}, {right.schema[key].dataType.simpleString()}")
    rank = F.col(order) if order else F.lit(None).cast("int")
    none_l, none_r = F.lit(None).cast(left.schema), F.lit(None).cast(right.schema)
    ours = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"),
                       F.lit(None).cast(right.schema[order].dataType if order else "int").alias("_rank"), F.struct(*left.columns).alias("_l"), none_r.alias("_r"))
    theirs = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("_key"), F.col(right_time).alias("_time"), F.lit(0).alias("_side"),
                                                               rank.alias("_rank"), none_l.alias("_l"), F.struct(*right.columns).alias("_r"))
    keys = ["_key", "_time", "_side", "_rank"]
    listed = ours.unionByName(theirs).repartitionByRange(*keys).sortWithinPartitions(*keys)
    path = scratch or scratch_path(spark, "asof")
    listed.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(path)
    rows = spark.read.parquet(path)

    # per task: its first key, which may go on from the tasks before, and what it knows of its last key
    ends = rows.groupBy("_task").agg(F.min_by(F.struct("_key"), "_at")["_key"].alias("first"), F.max_by(F.struct("_key"), "_at")["_key"].alias("last"))
    known = (rows.where("_side = 0").groupBy("_task", "_key").agg(F.max_by("_r", "_at").alias("_r")))
    lasts = ends.join(known, (ends["_task"] == known["_task"]) & ends["last"].eqNullSafe(known["_key"]), "left").select(
        ends["_task"].alias("task"), F.col("last").alias("key"), F.lit(1).alias("kind"), "_r")
    asks = ends.select(F.col("_task").alias("task"), F.col("first").alias("key"), F.lit(0).alias("kind"), none_r.alias("_r"))
    upto = Window.partitionBy("key").orderBy("task", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = (lasts.unionByName(asks).withColumn("carry", F.last("_r", ignorenulls=True).over(upto)).where("kind = 0")
               .select(F.col("task").alias("_ctask"), F.col("key").alias("_ckey"), "carry"))

    inside = Window.partitionBy("_task", "_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("_seen", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    met = filled.join(carried, (F.col("_task") == F.col("_ctask")) & F.col("_key").eqNullSafe(F.col("_ckey")), "left")
    found = F.when(F.col("_time").isNotNull(), F.coalesce("_seen", "carry"))
    return met.select("_l.*", found.alias("found"))

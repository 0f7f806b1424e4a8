"""Padding of a stored label log, safe beside a running stream and across crashes.

A pad run first reserves its ids with a mark (environment, from_id, max_id), which the label stream reads before it numbers a batch: from then on no
one else hands these ids out. Then the rows are written, then the reservation is closed by an empty file beside it. A run that finds an open
reservation of its environment writes its rows first, in the same folder, so that whatever a crash has left is made whole and nothing twice.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence
from ..session import exclusive, list_names, path_exists, publish
from ..sources.labels import BLOCK_IDS, in_blocks, read_log, with_block

PAD_MARK = "environment string, from_id long, max_id long"
MARK = "environment string, max_id long"


def pad_marks(marks_path: str) -> str:
    return f"{marks_path}_pads"


def _key(environment: str) -> str:
    return hashlib.sha256(environment.encode()).hexdigest()[:16]


def _closed(spark: SparkSession, marks_path: str, environment: str, cursor: int) -> str:
    return f"{marks_path}_pads_closed/{_key(environment)}-{cursor}"


def open_reservations(spark: SparkSession, marks_path: str, environment: str) -> list[tuple[int, int]]:
    """(from_id, max_id) of the environment's reservations whose rows may not be written yet."""
    if not path_exists(spark, pad_marks(marks_path)):
        return []
    marks = spark.read.schema(PAD_MARK).parquet(pad_marks(marks_path)).where(F.col("environment") == environment)
    closed = set(list_names(spark, f"{marks_path}_pads_closed"))
    return sorted((r["from_id"], r["max_id"]) for r in marks.collect() if f"{_key(environment)}-{r['max_id']}" not in closed and r["from_id"] is not None)


def _last_id(spark: SparkSession, log: DataFrame, marks_path: str, environment: str) -> int:
    """The last id of the environment that is written or reserved."""
    parts = [log.where(F.col("environment") == environment).select(F.max("id").alias("max_id"))]
    if path_exists(spark, pad_marks(marks_path)):
        parts.append(spark.read.schema(PAD_MARK).parquet(pad_marks(marks_path)).where(F.col("environment") == environment).select(F.max("max_id").alias("max_id")))
    return max((p.head()[0] or 0) for p in parts)


def pad_log(spark: SparkSession, log_path: str, marks_path: str, environment: str, cursor: int, did: str | None = None, block_ids: int = BLOCK_IDS,
            step: Callable[[str], None] = lambda name: None) -> int:
    """Append pad rows for every missing id up to ``cursor``; returns how many ids this call has reserved (0: the log is there already).
    ``step`` is called between the steps, for tests of crashes."""
    with exclusive(spark, f"{marks_path}_lock", f"pad-{uuid.uuid4().hex[:8]}"):
        for lo, hi in open_reservations(spark, marks_path, environment):
            _fill(spark, log_path, marks_path, environment, lo, hi, did, block_ids, step)
        last = _last_id(spark, read_log(spark, log_path), marks_path, environment)
        if last >= cursor:
            return 0
        step("counted")
        mark = spark.createDataFrame([(environment, last, cursor)], PAD_MARK).coalesce(1)
        mark.write.mode("overwrite").parquet(f"{pad_marks(marks_path)}/cursor={cursor}/environment_key={_key(environment)}")
        step("reserved")
        _fill(spark, log_path, marks_path, environment, last, cursor, did, block_ids, step)
        return cursor - last


def _fill(spark: SparkSession, log_path: str, marks_path: str, environment: str, last: int, cursor: int, did: str | None, block_ids: int,
          step: Callable[[str], None]) -> None:
    one = spark.createDataFrame([(environment, last, cursor)], "environment string, max_id long, cursor long")
    pads = sequence.pad_sequence(one.select("environment", "max_id"), one.select("environment", "cursor"), did=did).select(
        "environment", "id", F.lit(did or sequence.PAD_DID).alias("src"), "uri", F.lit(None).cast("string").alias("cid"),
        "val", "neg", F.current_timestamp().alias("cts"), F.lit(None).cast("timestamp").alias("exp"), F.lit(None).cast("binary").alias("sig"))
    # only this environment's partitions of the folder are replaced: others may have been padded to the same cursor
    folders = ["environment", "block"] if in_blocks(spark, log_path) else ["environment"]
    rows = with_block(pads, block_ids).select(*pads.columns, *folders[1:])
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders)
     .parquet(f"{log_path}/batch_id={-cursor}"))
    step("written")
    publish(spark, _closed(spark, marks_path, environment, cursor), "")
    step("closed")

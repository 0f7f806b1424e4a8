"""Label-log and settings tables on storage (S4, P8, T3, ST5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import lookup_with_default
from ..schemas import LABEL
from ..session import list_names, path_exists
from .versions import ConcurrentMerge, VersionedTable

ATTEMPTS = 10


def write_label_log(log: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the log partitioned by environment (every environment is a separate partition directory)."""
    log.write.mode(mode).partitionBy("environment").parquet(path)


#: Ids of a block of the stored log.
BLOCK_IDS = 1_000_000


def block_of(id_col, block_ids: int = BLOCK_IDS):  # noqa: ANN001, ANN201
    return ((id_col - F.pmod(id_col, F.lit(block_ids))) / block_ids).cast("long")


def with_block(log: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The log with the block of its ids, the partition column by which a cursor finds its files."""
    return log.withColumn("block", block_of(F.col("id"), block_ids))


def in_blocks(spark: SparkSession, path: str) -> bool:
    """Whether a log of batches is stored by blocks (a new one is; logs of old may have folders by environment only, and go on so)."""
    batch = next((n for n in list_names(spark, path) if n.startswith("batch_id=")), None)
    environment = next((n for n in list_names(spark, f"{path}/{batch}") if n.startswith("environment=")), None) if batch else None
    return environment is None or any(n.startswith("block=") for n in list_names(spark, f"{path}/{batch}/{environment}"))


def write_blocks(log: DataFrame, path: str, block_ids: int = BLOCK_IDS, mode: str = "overwrite") -> None:
    """Store the log in folders by environment and block of ids."""
    with_block(log, block_ids).write.mode(mode).partitionBy("environment", "block").parquet(path)


def read_after(spark: SparkSession, path: str, cursors: dict[str, int], block_ids: int = BLOCK_IDS) -> DataFrame:
    """The labels of each environment behind its cursor. Environment and block are partition filters: of a log of any length, only the blocks
    from the cursor's on are listed and read. ``cursors`` has an entry for each environment asked for."""
    held = F.lit(False)
    for environment, cursor in cursors.items():
        held = held | ((F.col("environment") == environment) & (F.col("block") >= cursor // block_ids) & (F.col("id") > cursor))
    return spark.read.parquet(path).where(held).drop("block", "batch_id")


def scan_label_log(spark: SparkSession, path: str, environment: str) -> DataFrame:
    """S4 + P8 + T3: one environment's labels in id order. The environment predicate is a partition
    filter, so other environments' files are never listed or read."""
    return read_log(spark, path).where(F.col("environment") == environment).orderBy("id")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored label log; a log that has not been written yet is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LABEL)
    return spark.read.parquet(path)


SETTINGS = "environment string, key string, value string"


def settings_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, SETTINGS)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """The stored settings; a table that has not been written yet, or whose first merge is at work, has none. Plain Parquet folders are
    read as they are."""
    return spark.read.parquet(path) if _is_plain(spark, path) else settings_table(spark, path).read()


def _is_plain(spark: SparkSession, path: str) -> bool:
    names = list_names(spark, path)
    return bool(names) and not {"parts", "manifests"} & set(names)


def save_setting(spark: SparkSession, path: str, environment: str, key: str, value: str) -> None:
    """One setting written. Readers see the old settings or the new ones, and only this environment's rows are rewritten; of two
    writers at a time the later one merges again. A plain Parquet folder is taken over first."""
    table = settings_table(spark, path)
    if _is_plain(spark, path):
        table.merge(spark.read.parquet(path).select("environment", "key", "value", F.lit(0).alias("seq")), ["environment", "key"], "seq")
    row = spark.createDataFrame([(environment, key, value, 1)], f"{SETTINGS}, seq int").coalesce(1)
    for attempt in range(ATTEMPTS):
        try:
            table.merge(row, ["environment", "key"], "seq")
            return
        except ConcurrentMerge:
            if attempt == ATTEMPTS - 1:
                raise


def setting(spark: SparkSession, settings: DataFrame, environment: str, key: str, default: str) -> str:
    """S8 for one key: the stored value or ``default``; a single value reaches the driver."""
    probe = spark.createDataFrame([(environment, key)], "environment string, key string")
    row = lookup_with_default(settings, probe, ["environment", "key"], "value", default).first()
    return row["value"]


def stream_enabled(spark: SparkSession, settings: DataFrame, environment: str,
                   key: str = "firehose_enabled") -> bool:
    """ST5: the persisted on/off flag decides whether the label stream is started (default on); only exactly
    ``true`` does."""
    return setting(spark, settings, environment, key, "true") == "true"

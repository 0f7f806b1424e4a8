"""What the corpus operators share: column checks, scratch tables, ASCII words."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import scratch_path

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def as_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back with its own schema. It cuts the
    lineage: a lost executor costs a reread, never a recomputation that could come out differently."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the folder, for those who drop it (``drop_scratch``) once no table depends on it."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package once per application, as ``--py-files`` would: they import the
    operators' helpers and keep vocabularies and caches between tasks."""
    sc = spark.sparkContext
    if getattr(sc, "_linkloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="linkloom-py-"), "linkloom_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._linkloom_shipped = True


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500):  # noqa: ANN201
    """Inside, whole texts go to the Python workers ``rows`` at a time: a batch of Spark's default 10,000 rows takes tens of MB on
    either side of the pipe, in each of an executor's tasks. The session's setting is put back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, size: int):  # noqa: ANN201
    """As ``small_batches``, by bytes instead of rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def limit_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """From now on, this session hands at most ``size`` bytes at a time to Python workers. Spark's default of 64 MB is held several times over, on
    both sides of the pipe and in each of an executor's tasks, and a worker keeps what it once took. For jobs whose plan is made later
    than the operator's call, where ``small_batches`` would have ended by then."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).removesuffix("b")) > size:
        spark.conf.set(key, str(size))


def release(spark: SparkSession) -> None:
    """Let the driver collect garbage now: shuffle files of finished steps go with the plans that made them, instead
    of at the cleaner's next half-hourly round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(prefix: str) -> str:
    """A column name that no input column can have by chance."""
    return f"_{prefix}_{uuid.uuid4().hex[:8]}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

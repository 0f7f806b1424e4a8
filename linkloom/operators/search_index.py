"""Substring search over the emission log by a trigram index.

    <path>/entries/zone=<z>/…      the entries in blocks of ``BLOCK_ROWS`` rows, ``ZONE_BLOCKS`` blocks to a folder, each with its number in the block
    <path>/postings/shelf=<s>/…    for each trigram and block the numbers of the rows that hold it, trigrams dealt over ``SHELVES`` folders

A row's trigrams are those of its text, title, labels and author, in lower case. A query of three letters or more can only be contained in rows that hold
all of its trigrams: their postings are read (the shelves prune the folders, the trigrams the row groups), intersected block by block, and what is left
is fetched from its zones and checked against the query itself, so the result is exactly that of ``reports.history_search``. Shorter queries are answered by a scan.

A list of postings is as long as a block at most; a trigram that every row holds has a list per block. Building shuffles a row per (trigram, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .reports import history_search

BLOCK_ROWS = 4096
ZONE_BLOCKS = 64
SHELVES = 64
GRAM = 3


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text (none of a shorter one)."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(0)), F.lit(1)), lambda i: F.substring(text, i, F.lit(GRAM))))


def _grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, grams_of(text)).otherwise(F.array().cast("array<string>"))


def _fields() -> Column:
    """Every field a query may be contained in, in lower case."""
    single = F.array(F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("author_did"), F.lit("")))
    return F.transform(F.concat(single, F.coalesce(F.col("labels"), F.array().cast("array<string>"))), F.lower)


def _zone(block: Column) -> Column:
    return F.floor(block / ZONE_BLOCKS).cast("long")


def _shelf(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHELVES)).cast("int")


def build_index(entries: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Write the entries in blocks, and the postings of their trigrams."""
    spark = entries.sparkSession
    listed = scratch_path(spark, "search-rows")
    entries.withColumn("_at", F.monotonically_increasing_id()).write.parquet(listed)
    rows = spark.read.parquet(listed)
    # numbers within a task are dense from its first on: blocks never cross tasks, and no count of all rows is needed
    task, number = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    numbered = rows.withColumns({"row": F.pmod(number, F.lit(block_rows)).cast("int"), "block": task * (1 << 20) + (number / block_rows).cast("long")}).drop("_at")
    numbered.withColumn("zone", _zone(F.col("block"))).sortWithinPartitions("zone", "block", "row").write.partitionBy("zone").parquet(f"{path}/entries")
    stored = spark.read.parquet(f"{path}/entries")
    grams = F.array_distinct(F.flatten(F.transform(_fields(), _grams)))
    postings = stored.select("block", "row", F.explode(grams).alias("gram")).groupBy("gram", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    shelved = postings.withColumn("shelf", _shelf(F.col("gram")))
    shelved.repartition("shelf").sortWithinPartitions("shelf", "gram", "block").write.partitionBy("shelf").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(zone, block, row) of the rows that hold every trigram of a query in lower case."""
    grams = sorted({query[i:i + GRAM] for i in range(len(query) - GRAM + 1)})
    postings = spark.read.parquet(f"{path}/postings")
    shelves = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_shelf(F.col("g"))).distinct().collect()]
    found = postings.where(F.col("shelf").isin(shelves) & F.col("gram").isin(grams))
    lists = found.groupBy("block").agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(grams))
    common = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return lists.select(_zone(F.col("block")).alias("zone"), "block", F.explode(common).alias("row"))


def indexed_search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """P12 over an index: the entries that contain the query, as ``history_search`` finds them."""
    needle = query.lower().strip()
    entries = spark.read.parquet(f"{path}/entries")
    if len(needle) < GRAM:
        return history_search(entries, query).drop("zone", "block", "row")
    return history_search(entries.join(candidates(spark, path, needle), ["zone", "block", "row"], "left_semi"), query).drop("zone", "block", "row")

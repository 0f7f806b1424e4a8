"""The label dimension over time (J2, J5): a link is matched with the article as it was when the post was written.

A snapshot is a whole label dimension (its active authors included) that holds from a time on until the next one. Versions are stretches of equal
rows of one URL over consecutive snapshots; an article that a snapshot lacks has no version there. Matching is one equi-join on the URL with the
stretch as a further condition, so a hot article is split like any other key of a join, and it works the same in a stream's batches.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import list_names, publish, read_text
from .articles import _probe
from .joins import DEFAULT_BROADCAST_ROWS, broadcast_if_small

COLUMNS = ["url", "article_id", "title", "section", "subsection", "tokens"]


def _stamp(at: str | None):  # noqa: ANN202
    return F.lit(at).cast("timestamp")


def dimension_versions(snapshots: list[tuple[str | None, DataFrame]]) -> DataFrame:
    """From snapshots (since, dimension) in order of time, where only the first may have no ``since`` (it holds from the beginning): the
    dimension's columns with valid_from (null: from the beginning) and valid_to (null: until further notice)."""
    times = [since for since, _ in snapshots]
    dated = times[1:] if times[0] is None else times
    if None in dated or any(a >= b for a, b in zip(dated, dated[1:])):
        raise ValueError("snapshots must be in order of time")
    held = [d.select(*COLUMNS).withColumns({"snapshot": F.lit(k), "valid_from": _stamp(since), "valid_to": _stamp(times[k + 1] if k + 1 < len(times) else None)})
            for k, (since, d) in enumerate(snapshots)]
    rows = functools.reduce(DataFrame.unionByName, held)
    # a URL has at most as many rows as there are snapshots
    order = Window.partitionBy("url").orderBy("snapshot")
    row = F.struct(*COLUMNS[1:])
    goes_on = (F.lag("snapshot").over(order) == F.col("snapshot") - 1) & F.lag(row).over(order).eqNullSafe(row)
    marked = rows.withColumn("opens", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    stretch = marked.withColumn("stretch", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first, last = F.min_by(F.struct(*COLUMNS[1:], "valid_from"), "snapshot"), F.max_by(F.struct("valid_to"), "snapshot")
    found = stretch.groupBy("url", "stretch").agg(first.alias("f"), last.alias("l"))
    return found.select("url", *[F.col(f"f.{c}").alias(c) for c in [*COLUMNS[1:], "valid_from"]], F.col("l.valid_to").alias("valid_to"))


def match_links_asof(links: DataFrame, versions: DataFrame, time_col: str = "ts", max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """J2 as of each link's time: the version of its article that held then. A link without a time matches nothing."""
    held = broadcast_if_small(versions.withColumnRenamed("url", "article_url"), max_broadcast_rows) if max_broadcast_rows > 0 else versions.withColumnRenamed("url", "article_url")
    at = F.col(time_col)
    during = at.isNotNull() & (F.col("valid_from").isNull() | (at >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    return _probe(links).join(held, (F.col("canonical_url") == F.col("article_url")) & during).drop("valid_from", "valid_to")


@dataclass
class DimensionStore:
    """Snapshots on storage: ``<path>/snapshots/<name>`` and, as the one file that switches readers, ``<path>/manifests/<number>.json``. A running stream
    asks for the versions in every batch and so follows snapshots that are added meanwhile; they are computed, counted and kept once per manifest."""

    spark: SparkSession
    path: str
    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS
    _kept: dict = field(default_factory=dict)

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in list_names(self.spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith("."))

    def snapshots(self) -> list[list[str | None]]:
        """(since, name) of every snapshot, in order."""
        numbers = self._numbers()
        return json.loads(read_text(self.spark, f"{self.path}/manifests/{numbers[-1]:09d}.json")) if numbers else []

    def add(self, since: dt.datetime | str | None, dimension: DataFrame) -> None:
        """Add a snapshot that holds from ``since`` on (UTC), later than any before it."""
        since = since.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(since, dt.datetime) else since
        known = self.snapshots()
        if known and (since is None or (known[-1][0] is not None and since <= known[-1][0])):
            raise ValueError(f"the snapshot of {since} is not later than that of {known[-1][0]}")
        number = max(self._numbers(), default=0) + 1
        name = f"{number:09d}-{uuid.uuid4().hex[:8]}"
        dimension.select(*COLUMNS).write.parquet(f"{self.path}/snapshots/{name}")
        if not publish(self.spark, f"{self.path}/manifests/{number:09d}.json", json.dumps([*known, [since, name]])):
            raise RuntimeError(f"another writer has added snapshot {number}; add this one again")

    def versions(self) -> DataFrame:
        numbers = self._numbers()
        if not numbers:
            raise LookupError(f"{self.path} has no snapshot yet")
        if numbers[-1] not in self._kept:
            for old in self._kept.values():
                old[0].unpersist()
            rows = dimension_versions([(since, self.spark.read.parquet(f"{self.path}/snapshots/{name}")) for since, name in self.snapshots()])
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
            small = rows.count() <= self.max_broadcast_rows
            self._kept.clear()
            self._kept[numbers[-1]] = (rows, F.broadcast(rows) if small else rows)
        return self._kept[numbers[-1]][1]

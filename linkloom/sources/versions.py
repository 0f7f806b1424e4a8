"""A stored table that is merged into by partitions and switched by one file (S5, S7, S10 on storage).

    <path>/parts/commit=<name>/<partition column>=<value>/part-*.parquet     never changed once written
    <path>/manifests/<number>.json                                           which commit holds each partition

A merge rewrites the partitions that its rows touch into a new commit, then publishes the next manifest: the one file whose appearance
switches readers from the old table to the new. Whatever happens before leaves the old table, whatever happens after the new; partitions that
are not touched keep their files. Two writers that start from one manifest cannot both publish the next: the later one is told, and has
changed nothing.

A reader looks up the latest manifest and scans its commits by partition filters, so that other commits, among them those of merges that died,
are never read. Commits that neither of the last ``KEEP`` manifests names are deleted by the merge that follows.

A manifest has an entry for each partition value, and a merge collects the values it touches (environments; at most ``MOST_PARTITIONS``, an
error beyond). Rows never pass the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import insert_ignore, upsert
from ..session import drop_path, list_names, path_exists, publish, read_text

KEEP = 2
MOST_PARTITIONS = 10_000
COMMIT = "commit"


class ConcurrentMerge(RuntimeError):
    """Another writer has published since this merge read the table; nothing was changed, so merge again."""


@dataclass
class Manifest:
    number: int = 0
    #: Partition value (None: null) → commit, as pairs, since JSON has no null keys.
    parts: list[list[str | None]] = field(default_factory=list)
    #: Writer → the last batch of it that is in the table.
    batches: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, partition_col: str = "environment"):
        self.spark, self.path, self.partition_col = spark, path.rstrip("/"), partition_col
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    # ------------------------------------------------------------ reading

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in list_names(self.spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, number: int | None = None) -> Manifest:
        """The manifest of this number, or the latest (number 0, without partitions, before the first merge)."""
        if number is None:
            number = max(self._numbers(), default=0)
        return Manifest(**json.loads(read_text(self.spark, f"{self.path}/manifests/{number:09d}.json"))) if number else Manifest()

    def read(self, number: int | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The table as of a manifest (the latest by default)."""
        return self._scan((manifest or self.manifest(number)).parts)

    def _scan(self, parts: list[list[str | None]]) -> DataFrame:
        names = self.schema.fieldNames()
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([f for f in self.schema if f.name != self.partition_col] + [T.StructField(COMMIT, T.StringType()), self.schema[self.partition_col]])
        by_commit: dict[str, list[str | None]] = {}
        for value, commit in parts:
            by_commit.setdefault(commit, []).append(value)
        held = None
        for commit, values in by_commit.items():
            this = (F.col(COMMIT) == commit) & self._is(values)
            held = this if held is None else held | this
        return self.spark.read.schema(stored).parquet(f"{self.path}/parts").where(held).select(*names)

    def _is(self, values: list[str | None]) -> Column:
        col, known = F.col(self.partition_col), [v for v in values if v is not None]
        found = col.isin(known) if known else F.lit(False)
        return found | col.isNull() if None in values else found

    # ------------------------------------------------------------ writing

    def merge(self, source: DataFrame, keys: list[str], order_col: str, how: str = "upsert", batch: tuple[str, int] | None = None,
              step: Callable[[str], None] = lambda name: None) -> int:
        """Merge ``source`` by ``keys`` (with the partition column among them) and return the manifest's number. ``how``: ``upsert`` (the last writer by
        ``order_col`` replaces the row) or ``ignore`` (rows that are there stay). ``batch``, a writer's name and a number that grows: a batch that
        is in the table already is left out, so that a replayed micro-batch changes nothing. ``step`` is called between the steps, for tests of crashes."""
        if self.partition_col not in keys:
            raise ValueError(f"{self.partition_col} must be one of the keys")
        before = self.manifest()
        if batch and before.batches.get(batch[0], -1) >= batch[1]:
            return before.number
        rows = source.persist()
        try:
            touched = [r[0] for r in rows.select(self.partition_col).distinct().limit(MOST_PARTITIONS + 1).collect()]
            if len(touched) > MOST_PARTITIONS:
                raise ValueError(f"a merge touches more than {MOST_PARTITIONS} partitions")
            if not touched and not batch:
                return before.number
            step("read")
            commit = f"{before.number + 1:09d}-{uuid.uuid4().hex[:8]}"
            if touched:
                target = self._scan([p for p in before.parts if p[0] in touched])
                merged = (upsert if how == "upsert" else insert_ignore)(target, rows, keys, order_col)
                (merged.select(*self.schema.fieldNames()).withColumn("_part", F.col(self.partition_col)).drop(self.partition_col)
                 .withColumnRenamed("_part", self.partition_col).write.partitionBy(self.partition_col).parquet(f"{self.path}/parts/{COMMIT}={commit}"))
        finally:
            rows.unpersist()
        step("written")
        after = Manifest(before.number + 1, [p for p in before.parts if p[0] not in touched] + [[v, commit] for v in touched], dict(before.batches))
        if batch:
            after.batches[batch[0]] = batch[1]
        if not publish(self.spark, f"{self.path}/manifests/{after.number:09d}.json", json.dumps(after.__dict__)):
            raise ConcurrentMerge(f"{self.path}: version {after.number} was published by another writer")
        step("published")
        self._clean()
        step("cleaned")
        return after.number

    def _clean(self) -> None:
        """Delete commits that no recent manifest names, and manifests before those. A commit numbered above the latest manifest may be
        another writer's, still at work, and stays."""
        numbers = sorted(self._numbers())
        named = {commit for n in numbers[-KEEP:] for _, commit in self.manifest(n).parts}
        for folder in list_names(self.spark, f"{self.path}/parts"):
            name = folder.removeprefix(f"{COMMIT}=")
            if folder.startswith(f"{COMMIT}=") and name not in named and int(name.split("-")[0]) <= numbers[-1]:
                drop_path(self.spark, f"{self.path}/parts/{folder}")
        for n in numbers[:-KEEP]:
            drop_path(self.spark, f"{self.path}/manifests/{n:09d}.json")

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.path}/manifests")


class MirrorSink:
    """``foreachBatch`` writer that upserts every batch into a stored table (the mirror of a dual write, S10). A replayed batch is recognised by
    its number and written once. Several rows of a key in one batch: the last by ``order_col`` counts."""

    def __init__(self, table: VersionedTable, keys: list[str], order_col: str, writer: str = "stream"):
        self.table, self.keys, self.order_col, self.writer = table, keys, order_col, writer

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.table.merge(batch, self.keys, self.order_col, batch=(self.writer, batch_id))

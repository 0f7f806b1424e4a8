"""Switching a running stream off and on (ST5).

The persisted flag is read before every micro-batch. Off, the batch is refused before anything of it is written: the query ends at the border
behind the last whole batch, and as the refused batch was never committed, the checkpoint offers the very same rows again when the flag is
back on. A query that waits for data has no batch to refuse; it is stopped between two triggers.

``run_feed`` keeps such a query: it starts it while the flag is on, waits while it is off, and notes every change of state, with the last whole
batch, as a row of the states table. A query that fails for any other reason is noted as failed, and its error raised.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources import labels as store

#: States of a feed.
RUNNING, PAUSED, FINISHED, FAILED = "running", "paused", "finished", "failed"
STATES = "environment string, state string, last_batch long, at timestamp"
_REFUSED = "feed switched off before batch"


class FeedPaused(RuntimeError):
    """The flag was off when a batch was about to start."""


@dataclass(frozen=True)
class Switch:
    """The persisted flag of one environment; on unless the setting says otherwise."""

    spark: SparkSession
    settings_path: str
    environment: str
    key: str = "firehose_enabled"

    def on(self) -> bool:
        return store.stream_enabled(self.spark, store.read_settings(self.spark, self.settings_path), self.environment, self.key)


@dataclass
class Gate:
    """A ``foreachBatch`` sink behind a switch: off, a batch is refused as a whole."""

    sink: Callable[[DataFrame, int], None]
    switch: Switch

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if not self.switch.on():
            raise FeedPaused(f"{_REFUSED} {batch_id}")
        self.sink(batch, batch_id)


@dataclass
class FeedListener(StreamingQueryListener):
    """Follows the queries of one feed: their last whole batches, rows read and batches done."""

    queries: set[str] = field(default_factory=set)
    last_batch: int | None = None
    rows: int = 0
    batches: int = 0

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        progress = event.progress
        if str(progress.id) in self.queries and progress.batchId >= 0 and progress.numInputRows:
            self.last_batch = max(progress.batchId, -1 if self.last_batch is None else self.last_batch)
            self.rows += progress.numInputRows
            self.batches += 1

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def last_committed(spark: SparkSession, checkpoint: str) -> int | None:
    """The last whole batch by the checkpoint's own record."""
    from ..session import list_names
    names = [int(n) for n in list_names(spark, f"{checkpoint}/commits") if n.isdigit()]
    return max(names, default=None)


@dataclass
class FeedStates:
    """The states table: a row for every change, appended."""

    spark: SparkSession
    path: str
    environment: str

    def note(self, state: str, last_batch: int | None) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        self.spark.createDataFrame([(self.environment, state, last_batch, now)], STATES).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(STATES).parquet(self.path).orderBy("at")


def run_feed(start: Callable[[], StreamingQuery], switch: Switch, checkpoint: str, states: FeedStates, poll_seconds: float = 1.0,
             stop: Callable[[], bool] = lambda: False, on_change: Callable[[str], None] = lambda state: None) -> FeedListener:
    """Keep the query that ``start`` starts (over ``Gate`` and ``checkpoint``) running while the switch is on, until it has finished by
    itself (``availableNow``) or ``stop`` says so. ``on_change`` is told every new state. Returns what the listener has counted."""
    spark, listener, noted = switch.spark, FeedListener(), None
    spark.streams.addListener(listener)

    def note(state: str) -> None:
        nonlocal noted
        if state != noted:
            noted = state
            states.note(state, last_committed(spark, checkpoint))
            on_change(state)

    try:
        while not stop():
            if not switch.on():
                note(PAUSED)
                time.sleep(poll_seconds)
                continue
            query = start()
            listener.queries.add(str(query.id))
            note(RUNNING)
            try:
                if _followed(query, switch, poll_seconds, stop):
                    note(FINISHED)
                    break
            except StreamingQueryException as error:
                if _REFUSED not in str(error):
                    note(FAILED)
                    raise
        return listener
    finally:
        spark.streams.removeListener(listener)


def _followed(query: StreamingQuery, switch: Switch, poll_seconds: float, stop: Callable[[], bool]) -> bool:
    """Wait for the query; True if it has ended by itself."""
    while not query.awaitTermination(poll_seconds):
        if (stop() or not switch.on()) and not query.status["isTriggerActive"]:
            query.stop()
            return False
    return True


def switched_intervals(history: DataFrame, default: bool = True) -> DataFrame:
    """From a settings history (environment, changed_at, value, order) the stretches in which a feed was on or off: environment, since (null: from
    the beginning), enabled. Only exactly ``true`` is on. Of several values at one time the last by ``order`` counts; a value that changes nothing
    opens no stretch. Each environment's history is ordered in one task, which holds for flags that people set."""
    from pyspark.sql import Window
    last = history.groupBy("environment", "changed_at").agg(F.max_by(F.struct("value"), F.struct("order"))["value"].alias("value"))
    on = F.coalesce(F.col("value") == "true", F.lit(False))
    order = Window.partitionBy("environment").orderBy("changed_at")
    known = last.select("environment", F.col("changed_at").alias("since"), on.alias("enabled"))
    known = known.withColumn("before", F.coalesce(F.lag("enabled").over(order.orderBy("since")), F.lit(default)))
    changed = known.where(F.col("enabled") != F.col("before")).select("environment", "since", "enabled")
    first = history.select("environment").distinct().select("environment", F.lit(None).cast("timestamp").alias("since"), F.lit(default).alias("enabled"))
    return first.unionByName(changed)

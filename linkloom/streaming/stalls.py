"""Stall alarms of a running stream (ST4): a feed's silence is reported when it has lasted for the threshold, not when it ends.

Messages are reduced inside their tasks to the first and last event of each feed and threshold-wide bucket; only those rows are shuffled, by feed, to a
keyed state. The state holds a feed's last settled event and the buckets that the watermark has not passed yet, so that events out of order within the
watermark's delay are put in their place first. A gap is reported when the watermark reaches the event that ends it; an event-time timer at the
end of the threshold reports a silence that still goes on, once, also when its feed never speaks again (as long as any feed moves the watermark).
State per feed: as many buckets as the delay is long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "feed string, kind string, since timestamp, until timestamp, seconds double"
#: since: the last event before; until: the event that ended the silence (null in an alarm).
GAP, ALARM = "gap", "alarm"
_STATE = "last_us long, alarmed boolean, pending array<struct<bucket:long,first_us:long,last_us:long>>"


def buckets_of(events: DataFrame, threshold_seconds: int) -> DataFrame:
    """From rows (feed, ts): the first and last event of every feed and bucket in each batch of a task, without a shuffle."""
    width = threshold_seconds * 1_000_000

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table([batch.column(0), pa.array(np.floor_divide(batch.column(1).to_numpy(), width)), batch.column(1)], names=["feed", "bucket", "us"])
            found = table.group_by(["feed", "bucket"], use_threads=False).aggregate([("us", "min"), ("us", "max")])
            yield from found.select(["feed", "bucket", "us_min", "us_max"]).rename_columns(["feed", "bucket", "first_us", "last_us"]).to_batches()

    known = events.where("ts IS NOT NULL").select("feed", F.unix_micros("ts").alias("us"))
    return known.mapInArrow(reduce, "feed string, bucket long, first_us long, last_us long")


def _step(last: int | None, alarmed: bool, pending: dict[int, list[int]], watermark: int, width: int) -> tuple[int | None, bool, list[tuple]]:
    """Settle what the watermark has reached; buckets stay pending until it has passed their end."""
    out = []
    for bucket in sorted(pending):
        first, end = pending[bucket]
        if first > watermark:
            break
        if last is not None and first - last >= width:
            out.append((GAP, last, first, (first - last) / 1e6))
        if last is None or end > last:
            last, alarmed = end, False
        if (bucket + 1) * width <= watermark:
            del pending[bucket]
    if last is not None and not alarmed and last + width <= watermark:
        out.append((ALARM, last, None, None))
        alarmed = True
    return last, alarmed, out


def stall_alarms(posts: DataFrame, feed: Column, threshold_seconds: int = 15, watermark: str = "10 seconds") -> DataFrame:
    """From a stream of posts (ts) the stream of gaps and alarms of every feed: feed, kind, since, until, seconds. A null feed is a feed
    without a name."""
    width = threshold_seconds * 1_000_000
    rows = buckets_of(posts.select(F.coalesce(feed.cast("string"), F.lit("")).alias("feed"), "ts"), threshold_seconds)
    dated = rows.withColumn("ts", F.timestamp_micros("last_us")).withWatermark("ts", watermark)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, alarmed, held = state.get if state.exists else (None, False, [])
        pending = {b: [f, e] for b, f, e in held}
        for frame in frames:
            for bucket, first, end in zip(frame["bucket"].tolist(), frame["first_us"].tolist(), frame["last_us"].tolist()):
                known = pending.setdefault(bucket, [first, end])
                known[:] = [min(known[0], first), max(known[1], end)]
        mark = state.getCurrentWatermarkMs() * 1000
        last, alarmed, out = _step(last, alarmed, pending, mark, width)
        state.update((last, alarmed, [(b, f, e) for b, (f, e) in sorted(pending.items())]))
        # the next time that anything can change without an event of this feed
        due = [f for f, _ in pending.values() if f > mark] + [(b + 1) * width for b in pending] + ([last + width] if last is not None and not alarmed else [])
        due = [d for d in due if d > mark]
        if due:
            state.setTimeoutTimestamp(max(-(-min(due) // 1000), mark // 1000 + 1))
        if out:
            stamp = lambda us: None if us is None else pd.Timestamp(us, unit="us")
            yield pd.DataFrame({"feed": [key[0]] * len(out), "kind": [o[0] for o in out], "since": [stamp(o[1]) for o in out],
                                "until": pd.Series([stamp(o[2]) for o in out], dtype="datetime64[us]"), "seconds": pd.Series([o[3] for o in out], dtype="float64")})

    return dated.groupBy("feed").applyInPandasWithState(follow, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

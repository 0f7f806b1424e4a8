"""The live last-40 series (A9): every second's count and the counts of the seconds before it, as the seconds pass.

Messages are counted by second inside their tasks; those rows are shuffled by feed and stretch of ``STRETCH`` seconds to a keyed state, which gives out
the stretch's ticks, so that a batch that spans much time is worked on by many tasks. A count near a stretch's end goes to the next one too, whose first
ticks need it. A tick is given out when the watermark passes its second: by an event-time timer also where no message comes, down to the tick whose
series is all zero; from there until the next message the series does not change and nothing is given out. Messages late within the watermark's delay
are counted in their own second. State per feed: of the stretches the watermark has not passed, the counts that later ticks need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds of a stretch.
STRETCH = 3_600
OUT = "feed string, tick timestamp, n long, series array<long>"
_STATE = "done long, counts array<struct<second:long,n:long>>"


def counted(events: DataFrame) -> DataFrame:
    """From rows (feed, ts): feed, second, n and the last event, per batch of a task, without a shuffle."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table([batch.column(0), pa.array(np.floor_divide(batch.column(1).to_numpy(), 1_000_000)), batch.column(1)], names=["feed", "second", "us"])
            found = table.group_by(["feed", "second"], use_threads=False).aggregate([("us", "count"), ("us", "max")])
            yield from found.select(["feed", "second", "us_count", "us_max"]).rename_columns(["feed", "second", "n", "last_us"]).to_batches()

    return events.where("ts IS NOT NULL").select("feed", F.unix_micros("ts").alias("us")).mapInArrow(reduce, "feed string, second long, n long, last_us long")


def _turn(done: int | None, counts: dict[int, int], points: int) -> int | None:
    """The next tick behind ``done``: the series changes until the newest count has left it; behind that, at the next count."""
    if done is not None and any(done - points < s <= done for s in counts):
        return done + 1
    return min((s for s in counts if done is None or s > done), default=None)


def ticks(done: int | None, counts: dict[int, int], upto: int, points: int) -> tuple[int | None, list[tuple[int, list[int]]]]:
    """The ticks behind ``done`` up to the second ``upto``, and the last of them; counts that no later tick needs are dropped. Takes time in
    proportion to the counts and the ticks."""
    held = sorted(counts.items())
    seconds, numbers = np.array([s for s, _ in held], "int64"), np.array([n for _, n in held], "int64")
    due = np.unique(seconds[:, None] + np.arange(points + 1))
    due = due[(due <= upto) & ((due > done) if done is not None else True)]
    if not len(due):
        return done, []
    series = np.zeros((len(due), points), "int64")
    for k in range(points):
        inside = (seconds + k >= due[0]) & (seconds + k <= due[-1])
        series[np.searchsorted(due, seconds[inside] + k), k] = numbers[inside]
    done = int(due[-1])
    for s, _ in held:
        if s <= done - points:
            del counts[s]
    return done, list(zip(due.tolist(), series.tolist()))


def live_series(posts: DataFrame, feed: Column, points: int = 40, watermark: str = "10 seconds") -> DataFrame:
    """From a stream of posts (ts) the stream of ticks: feed, tick, n, series (the newest second first)."""
    rows = counted(posts.select(F.coalesce(feed.cast("string"), F.lit("")).alias("feed"), "ts"))
    stretches = F.sequence(*[F.floor((F.col("second") + k) / STRETCH).cast("long") for k in (0, points)])
    dated = rows.select("*", F.explode(stretches).alias("stretch")).withColumn("ts", F.timestamp_micros("last_us")).withWatermark("ts", watermark)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        feed, first = key[0], int(key[1]) * STRETCH
        last = first + STRETCH - 1
        done, held = state.get if state.exists else (first - 1, [])
        counts = dict(map(tuple, held))
        for frame in frames:
            for second, n in zip(frame["second"].tolist(), frame["n"].tolist()):
                counts[second] = counts.get(second, 0) + n
        upto = state.getCurrentWatermarkMs() // 1000 - 1
        done, out = ticks(done, counts, min(upto, last), points)
        if upto >= last:
            state.remove()
        else:
            state.update((done, sorted(counts.items())))
            turn = _turn(done, counts, points)
            state.setTimeoutTimestamp((last if turn is None else min(turn, last)) * 1000 + 999)
        if out:
            yield pd.DataFrame({"feed": [feed] * len(out), "tick": pd.to_datetime([s for s, _ in out], unit="s"), "n": [series[0] for _, series in out],
                                "series": [series for _, series in out]})

    return dated.groupBy("feed", "stretch").applyInPandasWithState(follow, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

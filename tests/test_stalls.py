"""Stall alarms: gaps as the batch finds them, whatever the order of arrival, and alarms while a silence lasts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from linkloom.streaming.stalls import ALARM, GAP, _step, stall_alarms

WIDTH = 15_000_000


def _gaps(events, width=15.0):
    out, last = [], {}
    for feed, t in sorted(events):
        if feed in last and t - last[feed] >= width:
            out.append((feed, last[feed], t))
        last[feed] = t
    return out


def _write(spark, root, slices):
    for k, rows in enumerate(slices):
        spark.createDataFrame(rows, "feed string, t double").coalesce(1).write.json(f"{root}/topic/{k}")
        time.sleep(0.02)


def _run(spark, root, watermark):
    events = spark.readStream.schema("feed string, t double").option("maxFilesPerTrigger", "1").json(f"{root}/topic/*")
    posts = events.select("feed", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    found = stall_alarms(posts, F.col("feed"), 15, watermark)
    found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{root}/out").select("feed", "kind", F.unix_micros("since").alias("a"), F.unix_micros("until").alias("b"), "seconds").collect()
    return [(r.feed, r.kind, r.a / 1e6, r.b and r.b / 1e6, r.seconds) for r in rows]


@pytest.mark.parametrize("seed,delay", [(0, 0), (1, 40)])
def test_gaps_equal_the_batch_whatever_the_order(spark, tmp_path, seed, delay):
    rng = random.Random(seed)
    events = [(f, round(1_700_000_000 + t, 3)) for f in "ab" for t in {rng.uniform(0, 900) for _ in range(60)}]
    # the order of arrival: late by at most the watermark's delay
    events.sort(key=lambda e: e[1] + rng.uniform(0, delay))
    events.append(("clock", 1_700_000_000 + 1100.0))  # moves the watermark behind the others' last events
    slices = [events[i:i + 31] for i in range(0, len(events), 31)]
    _write(spark, str(tmp_path), slices)
    got = _run(spark, str(tmp_path), f"{delay + 1} seconds")
    assert sorted((f, round(a, 3), round(b, 3)) for f, kind, a, b, _ in got if kind == GAP) == sorted(_gaps(events))
    ends = {f: max(t for g, t in events if g == f) for f in "ab"}
    alarms = [(f, round(a, 3)) for f, kind, a, _, _ in got if kind == ALARM]
    assert {(f, ends[f]) for f in "ab"} <= set(alarms)  # ended feeds are reported, though no event follows
    starts = {(f, a) for f, a, _ in _gaps(events)} | set(ends.items())
    assert set(alarms) <= starts and len(alarms) == len(set(alarms))


def test_an_alarm_comes_before_the_event_that_ends_the_silence(spark, tmp_path):
    base = 1_700_000_000.0
    _write(spark, str(tmp_path), [[("a", base), ("b", base)], [("b", base + 20)], [("b", base + 30)], [("a", base + 40), ("b", base + 41)], [("b", base + 60)]])
    got = _run(spark, str(tmp_path), "0 seconds")
    feed = [(kind, a - base, b and b - base, s) for f, kind, a, b, s in got if f == "a"]
    assert sorted(feed, key=str) == sorted([(ALARM, 0.0, None, None), (GAP, 0.0, 40.0, 40.0), (ALARM, 40.0, None, None)], key=str)


def test_steps():
    pending = {0: [0, 5_000_000]}
    last, alarmed, out = _step(None, False, pending, 10_000_000, WIDTH)
    assert (last, alarmed, out, pending) == (5_000_000, False, [], {0: [0, 5_000_000]})  # more of the bucket may come
    last, alarmed, out = _step(last, alarmed, pending, 20_000_000, WIDTH)
    assert (last, alarmed, out, pending) == (5_000_000, True, [(ALARM, 5_000_000, None, None)], {})
    pending[3] = [50_000_000, 51_000_000]
    assert _step(last, alarmed, pending, 30_000_000, WIDTH) == (5_000_000, True, [])
    last, alarmed, out = _step(last, alarmed, pending, 50_000_000, WIDTH)
    assert (last, alarmed, out) == (51_000_000, False, [(GAP, 5_000_000, 50_000_000, 45.0)])

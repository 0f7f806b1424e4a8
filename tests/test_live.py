"""The live series at every tick, and the latest labels after any number of batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from linkloom.operators.sequence import latest_label
from linkloom.streaming import latest
from linkloom.streaming.live_series import STRETCH, live_series, ticks

BASE = 1_700_000_000


def _series(events, points, upto):
    out = {}
    for feed in {f for f, _ in events}:
        seconds = [int(t) for f, t in events if f == feed]
        for tick in {s + k for s in seconds for k in range(points + 1) if s + k <= upto}:
            out[feed, tick] = [seconds.count(tick - k) for k in range(points)]
    return out


@pytest.mark.parametrize("seed,delay,points", [(0, 0, 4), (1, 12, 40)])
def test_series_at_every_tick(spark, tmp_path, seed, delay, points):
    root, rng = str(tmp_path), random.Random(seed)
    events = [(f, BASE + round(t, 3)) for f in "ab" for t in (rng.choice([rng.uniform(0, 60), rng.uniform(0, 400)]) for _ in range(50))]
    events.sort(key=lambda e: e[1] + rng.uniform(0, delay))
    events.append(("clock", BASE + 600.0))
    for k in range(0, len(events), 26):
        spark.createDataFrame(events[k:k + 26], "feed string, t double").coalesce(1).write.json(f"{root}/topic/{k:04d}")
        time.sleep(0.02)
    stream = spark.readStream.schema("feed string, t double").option("maxFilesPerTrigger", "1").json(f"{root}/topic/*")
    posts = stream.select("feed", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    found = live_series(posts, F.col("feed"), points, f"{delay + 1} seconds")
    found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{root}/out").where("feed <> 'clock'").select("feed", F.unix_seconds("tick").alias("t"), "n", "series").collect()
    got = {(r.feed, r.t): list(r.series) for r in rows}
    assert len(got) == len(rows) and all(r.n == r.series[0] for r in rows)
    assert got == _series([e for e in events if e[0] != "clock"], points, BASE + 600 - delay - 2)


def test_ticks_stop_at_a_series_of_zeros():
    counts = {5: 2}
    done, out = ticks(None, counts, 4, 3)
    assert (done, out) == (None, [])
    done, out = ticks(None, counts, 6, 3)
    assert (done, out) == (6, [(5, [2, 0, 0]), (6, [0, 2, 0])])
    done, out = ticks(done, counts, 500, 3)
    assert (done, out, counts) == (8, [(7, [0, 0, 2]), (8, [0, 0, 0])], {})
    counts[300] = 1
    assert ticks(done, counts, 300, 3) == (300, [(300, [1, 0, 0])])


def test_ticks_take_time_in_proportion():
    class Counted(dict):
        seen = 0

        def __iter__(self):
            for s in super().__iter__():
                Counted.seen += 1
                yield s

    counts = Counted({7 * k: 1 for k in range(2_000)})
    done, out = ticks(None, counts, 14_100, 40)
    assert [t for t, _ in out] == list(range(7 * 1_999 + 41)) and all(s == [int((t - k) % 7 == 0 and 0 <= t - k <= 7 * 1_999) for k in range(40)] for t, s in out)
    assert (done, counts, Counted.seen <= 20_000) == (7 * 1_999 + 40, {}, True)


def test_series_across_stretches(spark, tmp_path):
    """Ticks go on where a stretch of the state ends, with messages on both sides, on one side only and none for a whole stretch."""
    root, start = str(tmp_path), BASE // STRETCH * STRETCH
    events = [("a", float(start + t)) for t in (3_590.5, 3_599.9, 3_600.0, 7_199.25, 4 * 3_600 - 40, 5 * 3_600 - 41, 6 * 3_600 - 1)] + [("clock", start + 30_000.0)]
    for k, part in enumerate((events[:1], events[1:4], events[4:6], events[6:])):
        spark.createDataFrame(part, "feed string, t double").coalesce(1).write.json(f"{root}/topic/{k:04d}")
        time.sleep(0.02)
    stream = spark.readStream.schema("feed string, t double").option("maxFilesPerTrigger", "1").json(f"{root}/topic/*")
    posts = stream.select("feed", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    found = live_series(posts, F.col("feed"), 40, "0 seconds")
    query = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{root}/out").where("feed <> 'clock'").select("feed", F.unix_seconds("tick").alias("t"), "series").collect()
    assert len({(r.feed, r.t) for r in rows}) == len(rows)
    assert {(r.feed, r.t): list(r.series) for r in rows} == _series(events[:-1], 40, start + 29_999)
    assert latest.state_rows(query) == 1  # stretches that are over leave the state


def test_latest_labels_after_every_batch(spark, tmp_path):
    root, rng = str(tmp_path), random.Random(5)
    schema = "environment string, id long, uri string, val string, cts timestamp"
    table, total, sizes = latest.latest_table(spark, f"{root}/latest"), None, []
    for number in range(4):
        rows = [(e, number * 100 + i, f"u{rng.randint(0, 6)}", rng.choice("xyz"), None) for e in ("dev", "prod") for i in range(40)]
        # days pass: what is over leaves the state
        batch = spark.createDataFrame(rows, schema).withColumn("cts", F.timestamp_seconds(F.lit(BASE + number * 3 * 86_400) + F.col("id") % 100))
        batch.coalesce(1).write.parquet(f"{root}/log/{number}")
        total = batch if total is None else total.unionByName(batch)
        log = spark.readStream.schema(schema).parquet(f"{root}/log/*")
        query = latest.start_latest_stream(log, table, f"{root}/c")
        query.awaitTermination()
        columns = ["environment", "uri", "val", "latest_id", "latest_cts", "n_emitted"]
        assert sorted(latest.read_latest(table).select(columns).collect()) == sorted(latest_label(total).select(columns).collect())
        sizes.append(latest.state_rows(query))
    assert max(sizes) <= 2 * 2 * 7 * 3 and sizes[-1] <= 2 * 7 * 3 * 2 < latest_label(total).count() * 3  # periods that are over are evicted

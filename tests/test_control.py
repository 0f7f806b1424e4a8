"""The live switch: a running stream stops at a batch border, resumes where it stopped, and notes what happened."""

import threading
import time

import pytest
from pyspark.errors import StreamingQueryException

from linkloom.sources.labels import save_setting
from linkloom.streaming import control


@pytest.fixture
def feed(spark, tmp_path):
    root = str(tmp_path)
    for k in range(5):
        spark.createDataFrame([(f"{k}-{i}",) for i in range(20)], "value string").coalesce(1).write.text(f"{root}/topic/{k}")
        time.sleep(0.02)
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", "1").load(f"{root}/topic/*")
    switch = control.Switch(spark, f"{root}/settings", "dev")
    states = control.FeedStates(spark, f"{root}/states", "dev")
    checkpoint = f"{root}/checkpoint"

    def start(sink, available_now=True):
        writer = lines.writeStream.foreachBatch(control.Gate(sink, switch)).option("checkpointLocation", checkpoint)
        return lambda: (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="100 milliseconds")).start()

    return root, switch, states, checkpoint, start


def _flip(spark, root, value):
    save_setting(spark, f"{root}/settings", "dev", "firehose_enabled", value)


def test_switched_off_after_a_batch_and_on_again(spark, feed):
    root, switch, states, checkpoint, start = feed
    seen, tries = [], []

    def sink(batch, batch_id):
        tries.append(batch_id)
        seen.extend((batch_id, r.value) for r in batch.collect())
        if batch_id == 1 and tries.count(1) == 1:
            _flip(spark, root, "false")

    changes = []

    def on_change(state):
        changes.append((state, sorted({b for b, _ in seen})))
        if state == control.PAUSED:
            _flip(spark, root, "true")

    listener = control.run_feed(start(sink), switch, checkpoint, states, poll_seconds=0.2, on_change=on_change)
    assert changes[0][0] == control.RUNNING and (control.PAUSED, [0, 1]) in changes and changes[-1][0] == control.FINISHED
    assert sorted(seen) == sorted((k, f"{k}-{i}") for k in range(5) for i in range(20))  # nothing lost, nothing twice
    assert tries == [0, 1, 2, 3, 4] and control.last_committed(spark, checkpoint) == 4
    noted = [(r.state, r.last_batch) for r in states.read().collect()]
    assert noted == [("running", None), ("paused", 1), ("running", 1), ("finished", 4)]
    assert listener.queries and listener.rows <= 100


def test_a_waiting_stream_is_stopped_and_started_by_the_flag(spark, feed):
    """Flipped from outside while no data arrives."""
    root, switch, states, checkpoint, start = feed
    seen, changes, done = [], [], threading.Event()

    def sink(batch, batch_id):
        seen.extend(r.value for r in batch.collect())

    def operator():
        def until(test):
            end = time.monotonic() + 60
            while not test() and time.monotonic() < end:
                time.sleep(0.1)
        until(lambda: len(seen) == 100)
        _flip(spark, root, "false")
        until(lambda: changes[-1:] == [control.PAUSED])
        spark.createDataFrame([("late",)], "value string").coalesce(1).write.text(f"{root}/topic/9")
        time.sleep(1)
        assert "late" not in seen
        _flip(spark, root, "true")
        until(lambda: "late" in seen)
        done.set()

    thread = threading.Thread(target=operator)
    thread.start()
    control.run_feed(start(sink, available_now=False), switch, checkpoint, states, poll_seconds=0.2, stop=done.is_set, on_change=changes.append)
    thread.join()
    assert done.is_set() and changes[:3] == ["running", "paused", "running"] and sorted(seen) == sorted([f"{k}-{i}" for k in range(5) for i in range(20)] + ["late"])


def test_off_from_the_start_and_other_failures(spark, feed):
    root, switch, states, checkpoint, start = feed
    _flip(spark, root, "off")
    polls = []
    control.run_feed(start(lambda b, i: polls.append("ran")), switch, checkpoint, states, poll_seconds=0.05, stop=lambda: len(polls) > 3 or polls.append(1))
    assert "ran" not in polls and [r.state for r in states.read().collect()] == ["paused"]
    _flip(spark, root, "true")

    def broken(batch, batch_id):
        raise ValueError("disk full")

    with pytest.raises(StreamingQueryException, match="disk full"):
        control.run_feed(start(broken), switch, checkpoint, states, poll_seconds=0.1)
    assert [r.state for r in states.read().collect()][-1] == "failed"


def test_intervals_of_a_history(spark):
    rows = [("a", 10, "true", 0), ("a", 20, "false", 0), ("a", 30, "no", 0), ("a", 40, "true", 1), ("a", 40, "false", 0), ("b", 5, "TRUE", 0), ("b", 9, None, 0)]
    history = spark.createDataFrame(rows, "environment string, s long, value string, order int").selectExpr("environment", "timestamp_seconds(s) AS changed_at", "value", "order")
    got = control.switched_intervals(history).selectExpr("environment", "unix_seconds(since) AS s", "enabled").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", None, True), ("a", 20, False), ("a", 40, True), ("b", None, True), ("b", 5, False)], key=str)

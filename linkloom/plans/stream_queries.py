"""Streaming versions of the flagship and the live reports, checked against the same oracle as the batch
queries. The message "topic" is the events-derived JSON lines written as text files under the shared
checkpoint folder; each query runs its stream to completion (``availableNow``), in several micro-batches, and reads the
sink back. Watermarks are wide here, as the batch twins drop nothing; tests cover late data beyond them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..operators.dimension_versions import DimensionStore
from ..session import scratch_path
from ..sources.labels import save_setting
from ..sources.replay import label_replay
from ..sources import posts as src
from ..streaming import control, latest
from ..streaming import label_stream as ls
from ..streaming.leases import LOG, IdLeases, LeasedLogSink
from ..streaming.live_series import live_series
from ..streaming.stalls import GAP, stall_alarms
from . import fixtures as fx
from .fixtures import DOMAIN, LABELER_DID


SLICES = 3
ROWS_PER_FILE = 5_000
#: Cursors of the subscribers to the stored log.
REPLAY_CURSORS = {"development": 25, "production": 40}


def _slices(spark: SparkSession, sf_dir: str, in_order: bool = True) -> tuple[list[DataFrame], int]:
    """The events of each slice, and how many files a slice has: by the number of events."""
    events = fx.read(spark, sf_dir, "events", parallel=True)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    # one plain pass for the cuts and the number; the events are dealt over the cores only where their messages are made
    at = F.percentile_approx(us, [k / SLICES for k in range(1, SLICES)], 100)
    found = fx.read(spark, sf_dir, "events").agg(at.alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    by_time = sum(((F.coalesce(us, F.lit(0)) >= c).cast("int") for c in found["cuts"] or []), F.lit(0))
    part = by_time if in_order else F.when(by_time == 0, F.lit(SLICES - 1)).otherwise(F.col("event_id") % (SLICES - 1))
    files = max(1, -(-found["n"] // (SLICES * ROWS_PER_FILE)))
    return [events.where(part == k) for k in range(SLICES)], files


def _write_slice(spark: SparkSession, sf_dir: str, root: str, k: int, events: DataFrame, files: int) -> None:
    fx.post_lines(spark, sf_dir, events).repartition(files).write.mode("overwrite").text(f"{root}/topic/slice{k}")


def _topic(spark: SparkSession, sf_dir: str, in_order: bool = True) -> tuple[str, DataFrame]:
    """The messages as ``SLICES`` folders in event-time order, one micro-batch each, of as many files as their size asks for; ``in_order=False`` lets
    the oldest arrive last, and cuts the others by id, so that late and out-of-order messages are in every batch."""
    root = scratch_path(spark, "stream")
    slices, files = _slices(spark, sf_dir, in_order)
    for k, events in enumerate(slices):
        _write_slice(spark, sf_dir, root, k, events, files)
    return root, ls.message_stream(spark, f"{root}/topic/*", max_files_per_trigger=files)


def _sink(root: str) -> ls.LabelSink:
    return ls.LabelSink(log_path=f"{root}/log", entries_path=f"{root}/entries", marks_path=f"{root}/marks",
                        recent_path=f"{root}/recent", environment_of=fx.environment_of, src_did=LABELER_DID)


def _run_labels(spark: SparkSession, sf_dir: str) -> tuple[str, ls.LabelSink]:
    from .queries import Flow
    root, lines = _topic(spark, sf_dir)
    sink = _sink(root)
    q = ls.start_label_stream(lines, Flow(spark, sf_dir).dimension, DOMAIN, sink, checkpoint=f"{root}/_checkpoint")
    q.awaitTermination()
    return root, sink


def q_label_posts_versions_stream(spark, sf_dir):
    """J2/J5 in a running stream: the revised articles are added to the store while it runs, behind its first batch."""
    from .queries import Flow, _entries_out
    root, lines = _topic(spark, sf_dir)
    flow, sink, store = Flow(spark, sf_dir), _sink(root), DimensionStore(spark, f"{root}/articles")
    store.add(None, flow.dimension)
    whole = ls.LineSink(DOMAIN, sink, store)

    def write(batch, batch_id):
        whole(batch, batch_id)
        if batch_id == 0:
            store.add(fx.REVISED_AT, flow.revised_dimension)

    (lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start().awaitTermination())
    return _entries_out(spark.read.parquet(sink.entries_path).drop("batch_id"))


def q_label_posts_switched_stream(spark, sf_dir):
    """ST5: the flag is switched off while the second batch is written; the stream stops behind it, waits, is switched on and goes on from its
    checkpoint: nothing is lost, nothing is there twice."""
    from .queries import Flow, _entries_out
    root, lines = _topic(spark, sf_dir)
    sink, settings, environment = _sink(root), f"{root}/settings", "production"
    whole = ls.LineSink(DOMAIN, sink, Flow(spark, sf_dir).dimension)
    switch = control.Switch(spark, settings, environment)

    def write(batch, batch_id):
        whole(batch, batch_id)
        if batch_id == 1:
            save_setting(spark, settings, environment, switch.key, "false")

    def on_change(state):
        if state == control.PAUSED:
            save_setting(spark, settings, environment, switch.key, "true")

    def start():
        return (lines.writeStream.foreachBatch(control.Gate(write, switch)).option("checkpointLocation", f"{root}/_checkpoint")
                .trigger(availableNow=True).start())

    control.run_feed(start, switch, f"{root}/_checkpoint", control.FeedStates(spark, f"{root}/states", environment), poll_seconds=0.2, on_change=on_change)
    return _entries_out(spark.read.parquet(sink.entries_path).drop("batch_id"))


def q_replay_stream(spark, sf_dir):
    """U3/ST6: subscribers of two environments, each from its cursor: the snapshot after the first slice, and after a restart the changes."""
    from .queries import Flow
    root, sink = scratch_path(spark, "replay"), None
    slices, files = _slices(spark, sf_dir)
    dimension, sink = Flow(spark, sf_dir).dimension, _sink(root)
    spark.dataSource.register(label_replay())

    def labels(names):
        for k in names:
            _write_slice(spark, sf_dir, root, k, slices[k], files)
        lines = ls.message_stream(spark, f"{root}/topic/*", max_files_per_trigger=files)
        ls.start_label_stream(lines, dimension, DOMAIN, sink, checkpoint=f"{root}/_checkpoint").awaitTermination()

    def subscribers():
        for environment, cursor in REPLAY_CURSORS.items():
            log = (spark.readStream.format("label_replay").options(log=sink.log_path, marks=sink.marks_path, environment=environment, cursor=str(cursor)).load())
            (log.writeStream.format("parquet").option("path", f"{root}/given/{environment}").option("checkpointLocation", f"{root}/_given/{environment}")
             .trigger(availableNow=True).start().awaitTermination())

    for names in ([0], [1, 2]):
        labels(names)
        subscribers()
    given = [spark.read.parquet(f"{root}/given/{environment}") for environment in REPLAY_CURSORS]
    return given[0].unionByName(given[1]).select("environment", "id", "uri", "val")


def q_label_sequence_leased(spark, sf_dir):
    """Two streams label different slices into one log at a time, with leased ids. Which writer gets which range is chance; per
    environment the ids are 1 to n and the labels are all there."""
    from .queries import Flow
    root = scratch_path(spark, "leased")
    slices, files = _slices(spark, sf_dir)
    for k, events in enumerate(slices):
        _write_slice(spark, sf_dir, f"{root}/{'first' if k % 2 else 'second'}", k, events, files)
    dimension, leases = Flow(spark, sf_dir).dimension, IdLeases(spark, f"{root}/leases")
    running = []
    for writer in ("first", "second"):
        lines = ls.message_stream(spark, f"{root}/{writer}/topic/*", max_files_per_trigger=files)
        sink = LeasedLogSink(leases, writer, fx.environment_of, src_did=LABELER_DID)
        running.append(ls.labelled_stream(lines, dimension, DOMAIN).writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/_{writer}")
                       .trigger(availableNow=True).start())
    for query in running:
        query.awaitTermination()
    log = leases.visible()
    ids = log.groupBy("environment").agg(F.countDistinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return log.groupBy("environment", "val").agg(F.count(F.lit(1)).alias("n_labels")).join(ids, "environment")


#: Gaps up to here are behind the last watermark at every scale.
STALLS_UNTIL = "2024-01-29 00:00:00"


def q_stall_alarms_stream(spark, sf_dir):
    """ST4 as it happens: the gaps of each environment's feed, by a keyed state with event-time timers."""
    root, lines = _topic(spark, sf_dir)
    found = stall_alarms(src.commit_posts(src.parse_messages(lines)), fx.environment_of(F.col("author_did")), watermark="0 seconds")
    (found.writeStream.format("parquet").option("path", f"{root}/stalls").option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True)
     .start().awaitTermination())
    gaps = spark.read.schema(found.schema).parquet(f"{root}/stalls").where((F.col("kind") == GAP) & (F.col("until") < F.lit(STALLS_UNTIL).cast("timestamp")))
    return gaps.select("feed", reports.iso(F.col("since")).alias("gap_start"), reports.iso(F.col("until")).alias("gap_end"), F.col("seconds").alias("gap_seconds"))


def q_throughput_last40_stream(spark, sf_dir):
    """A9 as the seconds pass: of every tick of each environment's feed its count, the sum of its last 40 and where they lie."""
    root, lines = _topic(spark, sf_dir)
    found = live_series(src.commit_posts(src.parse_messages(lines)), fx.environment_of(F.col("author_did")), watermark="0 seconds")
    (found.writeStream.format("parquet").option("path", f"{root}/ticks").option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True)
     .start().awaitTermination())
    ticks = spark.read.schema(found.schema).parquet(f"{root}/ticks").where(F.col("tick") < F.lit(STALLS_UNTIL).cast("timestamp"))
    moment = F.aggregate(F.transform("series", lambda n, k: n * k), F.lit(0).cast("long"), lambda a, b: a + b)
    return ticks.select("feed", reports.iso(F.col("tick")).alias("tick"), "n", F.aggregate("series", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_last40"), moment.alias("offsets_sum"))


def q_latest_label_stream(spark, sf_dir):
    """A6 kept up by a stream over the label log."""
    root, sink = _run_labels(spark, sf_dir)
    log = spark.readStream.schema(f"{LOG}, batch_id long, block long").option("maxFilesPerTrigger", "4").parquet(sink.log_path)
    table = latest.latest_table(spark, f"{root}/latest")
    # a slice spans ten days, and its files come in any order
    latest.start_latest_stream(log.drop("batch_id", "block"), table, f"{root}/_latest", watermark="15 days").awaitTermination()
    found = latest.read_latest(table)
    return found.select("environment", "uri", "val", "latest_id", reports.iso(F.col("latest_cts")).alias("latest_cts"), F.col("n_emitted").cast("long").alias("n_emitted"))


def q_label_posts_stream(spark, sf_dir):
    from .queries import _entries_out
    _, sink = _run_labels(spark, sf_dir)
    return _entries_out(spark.read.parquet(sink.entries_path).drop("batch_id"))


def q_label_sequence_stream(spark, sf_dir):
    from .queries import _log_out
    _, sink = _run_labels(spark, sf_dir)
    return _log_out(ls.read_log(spark, sink.log_path))


def q_recent_labels_stream(spark, sf_dir):
    """T4 / ST6: the newest-k table after the last batch."""
    from .queries import _entries_out
    _, sink = _run_labels(spark, sf_dir)
    return _entries_out(spark.read.parquet(f"{sink.recent_path}/batch_id={SLICES - 1}"))


def _run_rejects(spark: SparkSession, sf_dir: str) -> ls.RejectSink:
    from .queries import Flow
    root, lines = _topic(spark, sf_dir, in_order=False)
    sink = ls.RejectSink(f"{root}/dead_letters", f"{root}/unmatched", Flow(spark, sf_dir).dimension, DOMAIN)
    ls.start_reject_stream(lines, sink, f"{root}/_checkpoint").awaitTermination()
    return sink


def q_dead_letters_stream(spark, sf_dir):
    """The malformed messages the stream sets aside (their last characters)."""
    return spark.read.parquet(_run_rejects(spark, sf_dir).dead_letters_path).select(F.right("raw", F.lit(9)).alias("dead_letter"))


def q_unmatched_links_stream(spark, sf_dir):
    """Links without an article, as the stream reports them."""
    found = spark.read.parquet(_run_rejects(spark, sf_dir).unmatched_path)
    return found.select("uri", F.col("url_ord").cast("long").alias("url_ord"), "url", "canonical_url")


def q_stream_counters_stream(spark, sf_dir):
    """ST3: the A7 counters as a streaming global aggregate (one pass, stream-static left join) in complete
    mode."""
    from .queries import Flow
    root, lines = _topic(spark, sf_dir, in_order=False)
    counters = ls.counter_stream(lines, Flow(spark, sf_dir).dimension, DOMAIN)
    out = f"{root}/counters"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)

    q = (counters.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def q_throughput_1s_stream(spark, sf_dir):
    """ST2: 1-second event-time windows with a watermark, update mode; the sink keeps the newest count per
    window (batch-id keyed, so replays are idempotent)."""
    root, lines = _topic(spark, sf_dir, in_order=False)
    per_second = ls.throughput_stream(lines, watermark="3650 days")
    out = f"{root}/throughput"

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (per_second.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    latest = spark.read.parquet(out).groupBy("second").agg(F.max_by("n", "batch_id").alias("n"))
    return latest.select(reports.iso(F.col("second")).alias("second"), F.col("n").cast("long").alias("n"))


def q_stall_gaps_stream(spark, sf_dir):
    """ST4: watermarked bucket aggregate in update mode; the sink keeps the newest (first, last) per bucket
    (batch-id keyed) and the gaps are read off that bounded table."""
    root, lines = _topic(spark, sf_dir, in_order=False)
    out = f"{root}/buckets"

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (ls.stall_stream(lines, watermark="3650 days").writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    latest = (spark.read.parquet(out).groupBy("b")
              .agg(F.max_by(F.struct("first_us", "last_us"), "batch_id").alias("v"))
              .select("b", "v.first_us", "v.last_us"))
    return reports.gaps_from_buckets(latest)


STREAM_QUERIES = {
    "stall_gaps_stream": q_stall_gaps_stream,
    "label_posts_stream": q_label_posts_stream,
    "recent_labels_stream": q_recent_labels_stream,
    "dead_letters_stream": q_dead_letters_stream,
    "unmatched_links_stream": q_unmatched_links_stream,
    "label_sequence_stream": q_label_sequence_stream,
    "label_posts_versions_stream": q_label_posts_versions_stream,
    "label_posts_switched_stream": q_label_posts_switched_stream,
    "replay_stream": q_replay_stream,
    "label_sequence_leased": q_label_sequence_leased,
    "stall_alarms_stream": q_stall_alarms_stream,
    "throughput_last40_stream": q_throughput_last40_stream,
    "latest_label_stream": q_latest_label_stream,
    "stream_counters_stream": q_stream_counters_stream,
    "throughput_1s_stream": q_throughput_1s_stream,
}

# each streaming query is checked against the oracle of its batch twin
ORACLE_TWINS = {
    "stall_gaps_stream": "stall_gaps",
    "label_posts_stream": "label_posts",
    "recent_labels_stream": "recent_labels",
    "unmatched_links_stream": "unmatched_links",
    "label_sequence_stream": "label_sequence",
    "label_posts_versions_stream": "label_posts_versions",
    "latest_label_stream": "latest_label",
    "label_posts_switched_stream": "label_posts",
    "stream_counters_stream": "stream_counters",
    "throughput_1s_stream": "throughput_1s",
}

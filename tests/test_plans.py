"""Plan-shape regressions: the properties the design relies on at scale."""

from pyspark.sql import functions as F

from linkloom.operators import labels, reports
from linkloom.plans import fixtures as fx
from linkloom.plans import stream_queries
from linkloom.plans.queries import Flow, QUERIES
from linkloom.session import list_names
from linkloom.sources import posts as src


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_is_one_broadcast_join_over_pruned_scans(spark, sf_small):
    plan = executed(QUERIES["label_posts"](spark, sf_small))
    assert "BroadcastHashJoin [canonical_url" in plan
    assert "SortMergeJoin [canonical_url" not in plan
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line and "event_id" in line][0]
    assert "props" not in scan and "value" not in scan          # column pruning at the events scan


def test_active_authors_aggregates_map_side(spark, sf_small):
    plan = executed(QUERIES["active_authors"](spark, sf_small))
    assert "partial_count" in plan


def test_sequence_has_no_single_partition_step(spark, sf_small):
    plan = executed(QUERIES["label_sequence"](spark, sf_small))
    assert "SinglePartition" not in plan


def test_dedupe_articles_option(spark, sf_small):
    f = Flow(spark, sf_small)
    from linkloom.operators.articles import match_links
    m = match_links(f.links, f.dimension)
    every = labels.labelled_entries(m)
    first = labels.labelled_entries(m, dedupe_articles=True)
    pairs = every.select("uri", "article_id").distinct().count()
    assert first.count() == pairs < every.count()      # the fixture has posts linking one article twice
    assert first.groupBy("uri", "article_id").count().where(F.col("count") > 1).count() == 0


def test_match_without_broadcast_gives_same_rows(spark, sf_small):
    from linkloom.operators.articles import match_links
    f = Flow(spark, sf_small)
    small = match_links(f.links, f.dimension).select("uri", "url_ord", "article_id")
    big = match_links(f.links, f.dimension, max_broadcast_rows=1).select("uri", "url_ord", "article_id")
    hinted = small._jdf.queryExecution().optimizedPlan().toString()
    plain = big._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in hinted
    assert "strategy=broadcast" not in plain           # no hint: the join strategy is left to the planner / AQE
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))


def _event_scans(plan):
    return sum("FileScan parquet" in line and "event_id" in line for line in plan.split("\n"))


def test_reports_read_and_parse_the_events_once(spark, sf_small):
    plan = executed(QUERIES["throughput_last40"](spark, sf_small))
    final = plan.split("Initial Plan")[0]
    assert _event_scans(final) == 1 and final.count("from_json(") == 1
    buckets = executed(reports.stall_buckets(Flow(spark, sf_small).posts)).split("Initial Plan")[0]
    assert _event_scans(buckets) == 1 and buckets.count("from_json(") == 1
    assert _event_scans(executed(QUERIES["stall_gaps"](spark, sf_small))) == 0  # the gaps are read off the written buckets


def test_messages_are_tested_once_below_all_filters(spark):
    lines = spark.createDataFrame([('{"kind":"commit"}',), ("{bad",), ("{} {}",), ("[]]",), (None,)], "value string")
    messages = src.parse_messages(lines)
    plan = executed(src.commit_posts(messages).where("is_create"))
    assert [plan.count(f) for f in ("from_json(", "lengthOfJsonArray(", "jsonObjectKeys(")] == [1, 1, 1]
    assert [(r.raw, r.malformed, r.kind) for r in messages.collect()] == [('{"kind":"commit"}', False, "commit"), ("{bad", True, None), ("{} {}", True, None),
                                                                          ("[]]", True, None), (None, True, None)]


def test_topic_is_cut_in_one_plain_pass(spark, sf_small, monkeypatch):
    reads, read = [], fx.read
    monkeypatch.setattr(fx, "read", lambda s, d, name, parallel=False: reads.append((name, parallel)) or read(s, d, name, parallel))
    slices, files = stream_queries._slices(spark, sf_small)
    assert ("events", False) in reads and files == 1
    counts = [df.count() for df in slices]
    assert sum(counts) == read(spark, sf_small, "events").count() and max(counts) < 1.2 * min(counts)


def test_a_topic_has_files_by_its_size(spark, sf_small, monkeypatch):
    monkeypatch.setattr(stream_queries, "ROWS_PER_FILE", 100)
    root, lines = stream_queries._topic(spark, sf_small)
    files = [len([f for f in list_names(spark, f"{root}/topic/slice{k}") if f.startswith("part-")]) for k in range(stream_queries.SLICES)]
    assert min(files) == max(files) >= 3
    batches = []
    (lines.writeStream.foreachBatch(lambda b, i: batches.append((b.count(), b.rdd.getNumPartitions()))).option("checkpointLocation", f"{root}/c").trigger(availableNow=True)
     .start().awaitTermination())
    assert len(batches) == stream_queries.SLICES and all(n > 200 and tasks > 1 for n, tasks in batches)

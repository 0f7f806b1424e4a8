"""Live-report operators over posts and labelled entries: counters (A7), throughput (A8, A9), newest-k
(T4), history search and rendering (P12, F6–F11), stall gaps (ST4) and feed status (F12–F14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (encode_uri_component, feed_status, format_uptime, html_escape, post_web_link,
                              relative_age, tag_class, tag_display, title_default)
from ..session import scratch_path

ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(col):
    return F.date_format(col, ISO_MS)


def counters_one_pass(linked: DataFrame) -> DataFrame:
    """A7 from a single pass: ``linked`` has one row per processed post and link (``url_ord`` NULL for a
    post without links) with the matched ``tokens`` (NULL when unmatched), i.e. ``extract_links(...,
    keep_posts=True)`` left-joined with the label dimension. One global partial+final aggregate."""
    first_or_none = F.col("url_ord").isNull() | (F.col("url_ord") == 0)
    labels = F.when(F.col("tokens").isNotNull(), F.size("tokens")).otherwise(F.lit(0))
    agg = linked.agg(F.count_if(first_or_none).cast("long").alias("posts_processed"),
                     F.count_if(F.col("url_ord") == 0).cast("long").alias("posts_with_links"),
                     F.sum(labels).cast("long").alias("labels_emitted"),
                     F.max("ts").alias("last"))
    return agg.select("posts_processed", "posts_with_links",
                      F.coalesce(F.col("labels_emitted"), F.lit(0).cast("long")).alias("labels_emitted"),
                      iso(F.col("last")).alias("last_event"))


def throughput_1s(posts: DataFrame) -> DataFrame:
    """Processed events per 1-second tumbling window of event time (non-empty windows)."""
    return (posts.groupBy(F.window("ts", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("n"))
            .select(iso(F.col("w.start")).alias("second"), F.col("n").cast("long").alias("n")))


def throughput_last40(posts: DataFrame, points: int = 40) -> DataFrame:
    """The newest ``points`` seconds ending at the last event, zero-filled (offset 0 = newest). One pass over the posts: counts per
    second, of which the newest are a top-k; the series is read off those few rows."""
    per_sec = posts.where(F.col("ts").isNotNull()).groupBy(F.date_trunc("second", F.col("ts")).alias("sec")).agg(F.count(F.lit(1)).alias("n"))
    newest = per_sec.orderBy(F.col("sec").desc()).limit(points)
    one = newest.agg(F.max("sec").alias("last"), F.map_from_entries(F.collect_list(F.struct("sec", "n"))).alias("counts"))
    start = F.col("last") - F.make_interval(secs=F.lit(points - 1))
    spine = one.where(F.col("last").isNotNull()).select("counts", F.posexplode(F.reverse(F.sequence(start, F.col("last"), F.expr("interval 1 second")))).alias("offset", "sec"))
    return spine.select(F.col("offset").cast("long").alias("offset"), iso(F.col("sec")).alias("second"),
                        F.coalesce(F.try_element_at("counts", F.col("sec")), F.lit(0)).cast("long").alias("n"))


def recent_labels(entries: DataFrame, k: int = 500) -> DataFrame:
    """T4: the newest ``k`` entries (event time desc, then uri, link position). Top-k is the feature."""
    return entries.orderBy(F.col("ts").desc(), F.col("uri").asc(), F.col("url_ord").asc()).limit(k)


def history_search(entries: DataFrame, query: str) -> DataFrame:
    """Case-insensitive containment in text, title, any label or author DID; empty query = all."""
    q = query.lower().strip()
    if not q:
        return entries
    needle = F.lit(q)
    hit = (F.lower(F.coalesce(F.col("text"), F.lit(""))).contains(needle)
           | F.coalesce(F.lower(F.col("title")).contains(needle), F.lit(False))
           | F.exists("labels", lambda l: F.lower(l).contains(needle))
           | F.lower(F.col("author_did")).contains(needle))
    return entries.where(hit)


def history_report(entries: DataFrame, domain: str) -> DataFrame:
    """One row per (entry, label) with the rendered cells of the history table."""
    exploded = entries.select("*", F.posexplode("labels").alias("label_ord", "label"))
    return exploded.select(
        "entry_id", "label_ord",
        tag_class(F.col("label")).alias("tag_class"),
        tag_display(F.col("label")).alias("tag_text"),
        title_default(F.col("title")).alias("title_cell"),
        html_escape(F.coalesce(F.col("text"), F.lit(""))).alias("text_cell"),
        post_web_link(F.col("author_did"), F.col("uri")).alias("post_link"),
        F.concat(F.lit(f"https://www.{domain}/search?query="),
                 encode_uri_component(F.coalesce(F.col("title"), F.lit("")))).alias("search_link"))


def stall_buckets(posts: DataFrame, threshold_seconds: int = 15) -> DataFrame:
    """(b, first_us, last_us) per occupied ``threshold``-wide event-time bucket (partial+final aggregate)."""
    us = F.unix_micros(F.col("ts"))
    width = threshold_seconds * 1_000_000
    bucket = ((us - F.pmod(us, F.lit(width))) / width).cast("long")  # exact floor division
    return (posts.where(F.col("ts").isNotNull())
            .groupBy(bucket.alias("b"))
            .agg(F.min(us).alias("first_us"), F.max(us).alias("last_us")))


GAP_GROUP = 4096  # buckets per group, and groups per group of groups


def _with_previous(rows: DataFrame, key: str, value: str, levels: int) -> DataFrame:
    """Add ``prev``: the value of the row before, in order of the integer ``key``. Rows are ordered only within groups of
    ``GAP_GROUP`` neighbouring keys; a group's first row takes the last value of the group before, found in the same way one level
    up. Two levels of groups over 15-second buckets leave at most 2**64 µs / 15 s / 4096² = 73,300 keys for
    the top, whatever the clocks say; that is all a single task ever orders."""
    if not levels:
        return rows.withColumn("prev", F.lag(value).over(Window.orderBy(key)))
    group = f"{key}_g"
    grouped = rows.withColumn(group, ((F.col(key) - F.pmod(F.col(key), F.lit(GAP_GROUP))) / GAP_GROUP).cast("long"))
    inside = grouped.withColumn("_prev", F.lag(value).over(Window.partitionBy(group).orderBy(key)))
    last = grouped.groupBy(group).agg(F.max(value).alias("_last"))
    before = _with_previous(last, group, "_last", levels - 1).select(group, F.col("prev").alias("_group_prev"))
    return inside.join(before, group).withColumn("prev", F.coalesce("_prev", "_group_prev")).drop(group, "_prev", "_group_prev")


def gaps_from_buckets(buckets: DataFrame, threshold_seconds: int = 15) -> DataFrame:
    """Gaps of at least ``threshold`` between consecutive occupied buckets."""
    width = threshold_seconds * 1_000_000
    prev = _with_previous(buckets, "b", "last_us", 2).select("first_us", F.col("prev").alias("prev_us"))
    gaps = prev.where(F.col("prev_us").isNotNull() & (F.col("first_us") - F.col("prev_us") >= width))
    return gaps.select(iso(F.timestamp_micros("prev_us")).alias("gap_start"),
                       iso(F.timestamp_micros("first_us")).alias("gap_end"),
                       ((F.col("first_us") - F.col("prev_us")) / 1_000_000).cast("double").alias("gap_seconds"))


def stall_gaps(posts: DataFrame, threshold_seconds: int = 15) -> DataFrame:
    """ST4: silences of at least ``threshold_seconds`` between consecutive events.

    Inside one ``threshold``-wide bucket no such gap can exist, so only each occupied bucket's first and
    last event matter: events are pre-aggregated to that bucket table before anything is ordered. The levels above read the
    buckets several times, so they are written once: the posts are read in one pass.
    """
    spark = posts.sparkSession
    path = scratch_path(spark, "stall-buckets")
    buckets = stall_buckets(posts, threshold_seconds)
    buckets.write.parquet(path)
    return gaps_from_buckets(spark.read.schema(buckets.schema).parquet(path), threshold_seconds)


def feed_report(posts: DataFrame, as_of: str, stale_seconds: int = 15) -> DataFrame:
    """F12–F14 over per-author feeds: uptime since the first event, relative age of the last event, and
    Online / Connecting / Offline (connected = an event within ``stale_seconds`` of ``as_of``). The
    stream has no connection log; deletes seen stand in for reconnects."""
    at = F.lit(as_of).cast("timestamp")
    per = posts.groupBy("author_did").agg(F.min("ts").alias("first"), F.max("ts").alias("last"),
                                          F.count_if(F.col("operation") == "delete").alias("reconnects"))
    uptime = F.floor((F.unix_micros(at) - F.unix_micros(F.col("first"))) / 1_000_000)
    connected = (F.unix_micros(at) - F.unix_micros(F.col("last"))) <= stale_seconds * 1_000_000
    return per.select("author_did", format_uptime(uptime).alias("uptime"),
                      relative_age(iso(F.col("last")), at).alias("last_seen"),
                      feed_status(connected, F.col("reconnects")).alias("status"),
                      F.col("reconnects").cast("long").alias("reconnects"))

"""The public API and the label-log store (S4, ST5)."""

import tempfile

from linkloom import api
from linkloom.plans import fixtures as fx
from linkloom.plans.queries import Flow, q_label_posts
from linkloom.sources.labels import scan_label_log, stream_enabled, write_label_log


def test_api_label_posts_equals_flagship(spark, sf_small):
    posts = api.posts_from_lines(fx.post_lines(spark, sf_small))
    entries = api.label_posts(posts, fx.articles(spark, sf_small), fx.bridge(spark, sf_small),
                              fx.authors(spark, sf_small), fx.DOMAIN)
    got = sorted((r.uri, r.url_ord, ",".join(r.labels)) for r in entries.collect())
    want = sorted((r.uri, r.url_ord, r.labels) for r in q_label_posts(spark, sf_small).collect())
    assert got == want and len(got) > 0


def test_label_store_scan_and_order(spark, sf_small):
    path = tempfile.mkdtemp(prefix="linkloom-store-") + "/log"
    log = Flow(spark, sf_small).label_log
    write_label_log(log, path)
    dev = scan_label_log(spark, path, "development")
    ids = [r.id for r in dev.collect()]
    assert ids == sorted(ids) and ids == list(range(1, len(ids) + 1))
    assert "PartitionFilters: [isnotnull(environment" in dev._jdf.queryExecution().executedPlan().toString()


def test_stream_enabled_flag(spark):
    settings = spark.createDataFrame([("dev", "firehose_enabled", "false"), ("prod", "other", "x")],
                                     "environment string, key string, value string")
    assert stream_enabled(spark, settings, "dev") is False
    assert stream_enabled(spark, settings, "prod") is True

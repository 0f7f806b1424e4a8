"""S5/S7 upsert, S6 insert-or-ignore, S8 lookup with default, settings table."""

import tempfile

from linkloom.operators.merge import insert_ignore, lookup_with_default, upsert
from linkloom.sources import labels as store


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_overwrites_all_columns(spark):
    t = spark.createDataFrame([("dev", 1, "a", False), ("dev", 2, "b", False), ("prod", 1, "c", False)],
                              "environment string, id long, val string, neg boolean")
    s = spark.createDataFrame([("dev", 2, "B", True, 1), ("dev", 3, "n", False, 2)],
                              "environment string, id long, val string, neg boolean, seq long")
    assert _rows(upsert(t, s, ["environment", "id"], "seq")) == \
        [("dev", 1, "a", False), ("dev", 2, "B", True), ("dev", 3, "n", False), ("prod", 1, "c", False)]


def test_upsert_last_writer_wins(spark):
    t = spark.createDataFrame([("dev", "k", "0", 7)], "environment string, key string, value string, seq long")
    s = spark.createDataFrame([("dev", "k", "1", 1), ("dev", "k", "3", 3), ("dev", "k", "2", 2), ("dev", "k", "none", None)],
                              "environment string, key string, value string, seq long")
    # the order column stays where the target has it, and goes where it does not
    assert _rows(upsert(t, s, ["environment", "key"], "seq")) == [("dev", "k", "3", 3)]
    assert _rows(upsert(t.drop("seq"), s, ["environment", "key"], "seq")) == [("dev", "k", "3")]


def test_missing_order_keeps_the_row(spark):
    t = spark.createDataFrame([(1, "old")], "id long, v string")
    s = spark.createDataFrame([(1, "new", None), (2, None, None)], "id long, v string, seq long")
    assert sorted(map(str, _rows(upsert(t, s, ["id"], "seq")))) == ["(1, 'new')", "(2, None)"]


def test_insert_ignore_adds_a_new_key_once(spark):
    t = spark.createDataFrame([(1, "old")], "id long, v string")
    s = spark.createDataFrame([(1, "new", 1), (2, "second", 3), (2, "first", 2), (2, "third", 4)], "id long, v string, seq long")
    assert _rows(insert_ignore(t, s, ["id"], "seq")) == [(1, "old"), (2, "first")]
    assert _rows(insert_ignore(t, s, ["id"], "seq", max_broadcast_rows=0)) == [(1, "old"), (2, "first")]


def test_lookup_with_default(spark):
    table = spark.createDataFrame([("dev", "firehose", "false")], "environment string, key string, value string")
    probes = spark.createDataFrame([("dev", "firehose"), ("prod", "firehose")], "environment string, key string")
    assert _rows(lookup_with_default(table, probes, ["environment", "key"], "value", "true")) == \
        [("dev", "firehose", "false", False), ("prod", "firehose", "true", True)]


def test_upsert_and_insert_ignore_are_idempotent(spark):
    t = spark.createDataFrame([("dev", 1, "a"), ("dev", 2, "b")], "environment string, id long, val string")
    s = spark.createDataFrame([("dev", 2, "B", 1), ("dev", 3, "c", 1)], "environment string, id long, val string, seq long")
    once = upsert(t, s, ["environment", "id"], "seq")
    assert _rows(once) == _rows(upsert(once, s, ["environment", "id"], "seq"))
    i1 = insert_ignore(t, s, ["environment", "id"], "seq")
    assert _rows(i1) == _rows(insert_ignore(i1, s, ["environment", "id"], "seq")) == [("dev", 1, "a"), ("dev", 2, "b"), ("dev", 3, "c")]


def test_missing_tables_and_saved_settings(spark):
    root = tempfile.mkdtemp(prefix="linkloom-settings-")
    assert store.scan_label_log(spark, f"{root}/nolog", "development").count() == 0
    path = f"{root}/settings"
    assert store.stream_enabled(spark, store.read_settings(spark, path), "development")
    for value, enabled in (("TRUE", False), (" true", False), ("false", False), ("true", True)):
        store.save_setting(spark, path, "development", "firehose_enabled", value)
        store.save_setting(spark, path, "production", "other", "x")
        assert store.stream_enabled(spark, store.read_settings(spark, path), "development") == enabled
    assert store.read_settings(spark, path).count() == 2

"""Stored merges: a crash between any two steps, untouched partitions, replayed batches, concurrent writers."""

import os

import pytest

from linkloom.sources import labels as store
from linkloom.sources.versions import ConcurrentMerge, MirrorSink, VersionedTable

SCHEMA = "environment string, id long, val string"
STEPS = ["read", "written", "published", "cleaned"]


class Crash(Exception):
    pass


def _crash_at(name):
    def step(at):
        if at == name:
            raise Crash(name)
    return step


def _source(spark, rows):
    return spark.createDataFrame(rows, f"{SCHEMA}, seq long")


def _rows(table, **at):
    return sorted((tuple(r) for r in table.read(**at).collect()), key=str)


def _files(table):
    return {value: sorted(os.listdir(f"{table.path}/parts/commit={commit}/environment={value or '__HIVE_DEFAULT_PARTITION__'}")) for value, commit in table.manifest().parts}


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "log"), SCHEMA)
    t.merge(_source(spark, [("dev", 1, "a", 0), ("dev", 2, "b", 0), ("prod", 1, "c", 0), (None, 1, "n", 0)]), ["environment", "id"], "seq")
    return t


OLD = [("dev", 1, "a"), ("dev", 2, "b"), ("prod", 1, "c"), (None, 1, "n")]
NEW = [("dev", 1, "a"), ("dev", 2, "B"), ("dev", 3, "d"), ("prod", 1, "c"), (None, 1, "n")]


@pytest.mark.parametrize("at", STEPS)
def test_a_crash_between_steps_leaves_the_old_table_or_the_new(spark, table, at):
    source = _source(spark, [("dev", 2, "x", 1), ("dev", 2, "B", 2), ("dev", 3, "d", 1)])
    before = _files(table)
    with pytest.raises(Crash):
        table.merge(source, ["environment", "id"], "seq", batch=("s", 4), step=_crash_at(at))
    assert _rows(table) == sorted(OLD if at in STEPS[:2] else NEW, key=str)
    table.merge(source, ["environment", "id"], "seq", batch=("s", 4))
    assert _rows(table) == sorted(NEW, key=str)
    after = _files(table)
    assert after["prod"] == before["prod"] and after["dev"] != before["dev"]  # only the touched environment is rewritten
    table.merge(_source(spark, [("dev", 9, "late", 1)]), ["environment", "id"], "seq")
    table.merge(_source(spark, [("dev", 9, None, None)]), ["environment", "id"], "seq", how="ignore")
    assert (("dev", 9, "late")) in _rows(table)
    # commits of dead merges, and those no recent manifest names, are gone
    named = {c for n in sorted(table._numbers())[-2:] for _, c in table.manifest(n).parts}
    assert {f.removeprefix("commit=") for f in os.listdir(f"{table.path}/parts") if f.startswith("commit=")} == named


def test_a_reader_keeps_its_version(spark, table):
    held = table.read()
    table.merge(_source(spark, [("dev", 2, "B", 2)]), ["environment", "id"], "seq")
    assert sorted((tuple(r) for r in held.collect()), key=str) == sorted(OLD, key=str)
    assert _rows(table, number=1) == sorted(OLD, key=str)
    plan = table.read().where("environment = 'dev'")._jdf.queryExecution().executedPlan().toString()
    assert "commit" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]  # other commits are not read


def test_the_later_of_two_writers_is_told(spark, table):
    other = VersionedTable(spark, table.path, SCHEMA)

    def overtaken(at):
        if at == "written":
            other.merge(_source(spark, [("prod", 7, "other", 0)]), ["environment", "id"], "seq")

    with pytest.raises(ConcurrentMerge):
        table.merge(_source(spark, [("dev", 7, "own", 0)]), ["environment", "id"], "seq", step=overtaken)
    assert ("prod", 7, "other") in _rows(table) and ("dev", 7, "own") not in _rows(table)
    table.merge(_source(spark, [("dev", 7, "own", 0)]), ["environment", "id"], "seq")
    assert {("prod", 7, "other"), ("dev", 7, "own")} <= set(_rows(table))


def test_replayed_batches_count_once(spark, table):
    sink = MirrorSink(table, ["environment", "id"], "seq")
    first, second = _source(spark, [("dev", 1, "one", 0)]), _source(spark, [("dev", 1, "two", 0)])
    for batch, number in ((first, 0), (second, 1), (first, 0), (_source(spark, []), 2)):
        sink(batch, number)
    assert ("dev", 1, "two") in _rows(table) and table.manifest().batches == {"stream": 2}


def test_merge_needs_the_partition_among_its_keys(spark, table):
    with pytest.raises(ValueError, match="environment"):
        table.merge(_source(spark, [("dev", 1, "x", 0)]), ["id"], "seq")


def test_settings_survive_a_crash_and_take_over_plain_folders(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "settings")
    spark.createDataFrame([("dev", "a", "1"), ("prod", "a", "2")], store.SETTINGS).write.parquet(path)
    store.save_setting(spark, path, "dev", "b", "3")
    want = [("dev", "a", "1"), ("dev", "b", "3"), ("prod", "a", "2")]
    assert sorted(map(tuple, store.read_settings(spark, path).collect())) == want
    from linkloom.sources import versions
    monkeypatch.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(Crash()))
    with pytest.raises(Crash):
        store.save_setting(spark, path, "dev", "a", "9")
    assert sorted(map(tuple, store.read_settings(spark, path).collect())) == want

"""Padding beside a stream and across crashes; the replay source from any cursor, across restarts."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.sources.labels import read_after, write_blocks
from linkloom.sources.replay import label_replay
from linkloom.streaming import label_stream as ls
from linkloom.streaming.padding import open_reservations, pad_log

ENTRIES = "uri string, author_did string, text string, ts timestamp, url_ord int, url string, article_id long, title string, labels array<string>, entry_id string"


class Crash(Exception):
    pass


def _sink(root, block_ids=10):
    return ls.LabelSink(log_path=f"{root}/log", entries_path=f"{root}/entries", marks_path=f"{root}/marks", block_ids=block_ids,
                        environment_of=lambda did: F.regexp_extract(did, "^[a-z]+", 0))


def _batch(spark, number, size, environments=("dev", "prod")):
    rows = [(f"at://{e}/{number}/{i}", f"{e}1", "t", None, 0, "u", 1, "x", ["news", "us"], f"{number}{i}") for e in environments for i in range(size)]
    return spark.createDataFrame(rows, ENTRIES).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))


def _log(spark, root):
    return sorted((r.environment, r.id, r.val) for r in ls.read_log(spark, f"{root}/log").collect())


def _ids(spark, root, environment):
    return sorted(i for e, i, _ in _log(spark, root) if e == environment)


@pytest.mark.parametrize("at", ["counted", "reserved", "written", "closed"])
def test_a_crash_of_padding_never_gives_an_id_twice(spark, tmp_path, at):
    root = str(tmp_path)
    sink = _sink(root)
    sink(_batch(spark, 0, 3), 0)  # ids 1 to 6 in both environments

    def step(name):
        if name == at:
            raise Crash

    with pytest.raises(Crash):
        pad_log(spark, f"{root}/log", f"{root}/marks", "dev", 25, step=step)
    sink(_batch(spark, 1, 2), 1)  # the stream goes on before anyone repairs
    pad_log(spark, f"{root}/log", f"{root}/marks", "dev", 25)
    pad_log(spark, f"{root}/log", f"{root}/marks", "dev", 25)
    dev = _ids(spark, root, "dev")
    assert dev == list(range(1, len(dev) + 1)) and len(dev) == (25 if at == "counted" else 29)  # dense and each once
    assert _ids(spark, root, "prod") == list(range(1, 11))
    assert open_reservations(spark, f"{root}/marks", "dev") == []
    sink(_batch(spark, 2, 1), 2)
    dev = _ids(spark, root, "dev")
    assert dev == list(range(1, len(dev) + 1))


def _subscribe(spark, root, cursor, name, environment="dev"):
    stream = spark.readStream.format("label_replay").options(log=f"{root}/log", marks=f"{root}/marks", environment=environment, cursor=str(cursor), block_ids="10").load()
    (stream.writeStream.format("parquet").option("path", f"{root}/given/{name}").option("checkpointLocation", f"{root}/_given/{name}")
     .trigger(availableNow=True).start().awaitTermination())
    return sorted(r.id for r in spark.read.schema(stream.schema).parquet(f"{root}/given/{name}").collect())


def test_every_label_once_from_any_cursor_across_restarts(spark, tmp_path):
    root = str(tmp_path)
    sink, rng = _sink(root), random.Random(2)
    spark.dataSource.register(label_replay())
    cursors = [0, 1, 9, 10, 11, 37, 500]
    size = 0
    for number in range(4):
        n = rng.randint(0, 9)
        sink(_batch(spark, number, n), number)
        size += 2 * n
        if number == 1:
            pad_log(spark, f"{root}/log", f"{root}/marks", "dev", size + 13, block_ids=10)
            size += 13
        for cursor in cursors[number % 2::2] + cursors[:2]:
            assert _subscribe(spark, root, cursor, f"c{cursor}") == list(range(cursor + 1, size + 1))
    assert _ids(spark, root, "dev") == list(range(1, size + 1))
    snapshot = spark.read.format("label_replay").options(log=f"{root}/log", marks=f"{root}/marks", environment="dev", cursor="5", block_ids="10").load()
    want = sorted(ls.read_log(spark, f"{root}/log", "dev").where("id > 5").select("id", "uri", "val", "neg", "cts", "exp", "sig").collect(), key=lambda r: r.id)
    assert sorted(snapshot.select("id", "uri", "val", "neg", "cts", "exp", "sig").collect(), key=lambda r: r.id) == want


def test_ids_behind_an_open_reservation_wait(spark, tmp_path):
    root = str(tmp_path)
    sink = _sink(root)
    spark.dataSource.register(label_replay())
    sink(_batch(spark, 0, 2), 0)  # 1 to 4

    def step(name):
        if name == "reserved":
            raise Crash

    with pytest.raises(Crash):
        pad_log(spark, f"{root}/log", f"{root}/marks", "dev", 20, block_ids=10, step=step)
    sink(_batch(spark, 1, 1), 1)  # 21 and 22: visible only when 5 to 20 are
    assert _subscribe(spark, root, 0, "s") == [1, 2, 3, 4]
    pad_log(spark, f"{root}/log", f"{root}/marks", "dev", 1, block_ids=10)
    assert _subscribe(spark, root, 0, "s") == list(range(1, 23))
    assert _subscribe(spark, root, 0, "empty", environment="none") == []


def test_a_cursor_opens_only_the_blocks_behind_it(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.range(1, 1001).selectExpr("CASE WHEN id % 2 = 0 THEN 'dev' ELSE 'prod' END AS environment", "id", "'v' AS val")
    write_blocks(log, path, block_ids=100)
    tail = read_after(spark, path, {"dev": 950}, block_ids=100)
    assert sorted(r.id for r in tail.collect()) == list(range(952, 1001, 2))
    files = {f.split("block=")[1].split("/")[0] for f in (r[0] for r in tail.select(F.input_file_name()).distinct().collect())}
    assert files <= {"9", "10"}
    plan = tail._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "block" in filters and "environment" in filters


def test_two_streams_on_one_output(spark, tmp_path, monkeypatch):
    """A second stream, with a checkpoint of its own, cannot take over the first one's lock."""
    from linkloom.session import exclusive
    root = str(tmp_path)
    spark.createDataFrame([("x",)], "value string").write.text(f"{root}/topic")
    lines = spark.readStream.format("text").load(f"{root}/topic")
    owners = []

    def note(spark_, path, owner, wait_seconds=60.0):
        owners.append(owner)
        return exclusive(spark_, path, owner, 0.5)

    monkeypatch.setattr(ls, "exclusive", note)
    batch = _batch(spark, 0, 1)
    for k in (0, 0, 1):
        sink = _sink(f"{root}/{len(owners)}")
        query = lines.writeStream.foreachBatch(lambda b, i: sink(batch, 0)).option("checkpointLocation", f"{root}/_c{k}-{len(owners)}").trigger(availableNow=True).start()
        query.awaitTermination()
    assert len(set(owners)) == 3 and all(o.startswith("stream ") and len(o) > 20 for o in owners)
    with exclusive(spark, f"{root}/held_lock", owners[0]):
        with exclusive(spark, f"{root}/held_lock", owners[0]):  # a batch that is run again
            pass
    with exclusive(spark, f"{root}/held_lock", owners[0]):
        with pytest.raises(TimeoutError):
            with exclusive(spark, f"{root}/held_lock", owners[1], 0.3):
                pass

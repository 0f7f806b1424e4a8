import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom.llm import sharding


def _least(sizes, shards):
    """The smallest capacity for which a greedy walk needs at most so many shards, by trying them."""
    low, high = max([*sizes, -(-sum(sizes) // shards)]), sum(sizes)

    def fits(c):
        used, here = 1, 0
        for s in sizes:
            if here + s > c:
                used, here = used + 1, 0
            here += s
        return used <= shards

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def check(rows, got, shards):
    texts = [t or "" for _, t in rows]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for (i, _), t in zip(rows, texts))
    groups = Counter()
    for t in texts:
        groups[hashlib.sha256(t.encode()).digest()] += len(t.encode()) + 16
    order = sorted(groups)
    used = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        used[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [groups[g] for g in order]
    if sizes:
        assert max(used.values()) == _least(sizes, shards)
    return used, order


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("seed,summary", [(0, 4), (1, 16), (2, 1 << 16), (3, 64)])
def test_no_smaller_capacity_would_do(spark, seed, summary):
    rng = random.Random(seed)
    texts = ["é" * rng.choice([0, 1, 5, 40, 300, 3000]) + str(rng.randint(0, 400)) for _ in range(500)]
    texts += ["copy " * 20] * rng.choice([0, 3, 250])
    rows = [(rng.randint(0, 300) if rng.random() < 0.9 else None, t) for t in texts]
    got = sharding.shard_rows(_docs(spark, rows), 7, summary=summary).collect()
    used, order = check(rows, got, 7)
    by_id = {hashlib.sha256((t or "").encode()).digest(): set() for _, t in rows}
    places = {(r.doc_id, r["size"], r.text_crc32): r.shard for r in got}
    for i, t in rows:
        by_id[hashlib.sha256(t.encode()).digest()].add(places[i, len(t.encode()) + 16, zlib.crc32(t.encode())])
    assert all(len(s) == 1 for s in by_id.values())  # equal texts stay together
    shards = [min(by_id[g]) for g in order]
    assert shards == sorted(shards)  # stretches of the order


def test_sizes_are_even_and_a_large_group_has_its_own(spark):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 200)) for i in range(6000)]
    used, _ = check(rows, sharding.shard_rows(_docs(spark, rows)).collect(), 40)
    mean = sum(used.values()) / 40
    assert len(used) == 40 and max(used.values()) < 1.02 * mean and min(used.values()) > 0.98 * mean
    rows += [(10_000 + i, "one and the same " * 8) for i in range(3000)]
    used, _ = check(rows, sharding.shard_rows(_docs(spark, rows)).collect(), 40)
    others = sorted(used.values())[:-1]
    assert len(others) == 39 and others[-1] < 1.05 * others[1]  # what lies before the large group may not fill a shard


def test_fewer_groups_than_shards(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c" * 100)]
    used, _ = check(rows, sharding.shard_rows(_docs(spark, rows)).collect(), 40)
    assert len(used) == 3


def test_hard_rows(hard, nothing, hard_rows):
    rows = [(r[0], r[1]) for r in hard_rows]
    got = sharding.shard_rows(hard, 5)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(rows, got.collect(), 5)
    assert sharding.shard_rows(nothing).count() == 0


def test_written_shards_are_the_assigned_ones(spark, tmp_path, hard):
    rows = [(i % 150, f"text {i % 170} " + "é" * (i % 90)) for i in range(700)] + [(900, None), (901, "")]
    docs = _docs(spark, rows).withColumn("shard", F.lit("own"))
    column = sharding.write_shards(docs, str(tmp_path / "shards"), 9)
    assert column == "_shard"
    back = spark.read.parquet(str(tmp_path / "shards"))
    key = lambda i, t, s: (str(i), zlib.crc32((t or "").encode()), s)
    want = Counter((str(r.doc_id), r.text_crc32, r.shard) for r in sharding.shard_rows(docs, 9).collect())
    assert Counter(key(r.doc_id, r.text, r["_shard"]) for r in back.collect()) == want
    sharding.write_shards(hard, str(tmp_path / "hard"), 40)
    assert spark.read.parquet(str(tmp_path / "hard")).count() == hard.count()

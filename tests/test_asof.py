import random

import pytest

from linkloom.operators.asof import asof_join

L, R = "k string, t long, n long", "k string, t long, o long, v string"


def _brute(left, right):
    out = []
    for k, t, n in left:
        best = [r for r in right if r[0] == k and r[1] is not None and t is not None and r[1] <= t]
        top = max(best, key=lambda r: (r[1], r[2] is not None, r[2] or 0), default=None)
        out.append((k, t, n, None if top is None else top[1], None if top is None else top[3]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,hot", [(0, 0.0), (1, 0.9), (2, 0.4)])
def test_latest_row_at_or_before(spark, seed, hot):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
    left = [(key(), rng.choice([None, *range(60)]), n) for n in range(400)]
    right = [(k, t, None if o == 2 else o, f"{k}{t}{o}") for k, t, o in {(key(), rng.choice([None, *range(0, 60, 7)]), rng.randint(0, 6)) for _ in range(70)}]
    got = asof_join(spark.createDataFrame(left, L).repartition(5), spark.createDataFrame(right, R), "k", "t", "t", "o")
    assert sorted(((r.k, r.t, r.n, r.found and r.found.t, r.found and r.found.v) for r in got.collect()), key=str) == _brute(left, right)


def test_other_side_only_in_earlier_tasks(spark):
    left = [("x", t, t) for t in range(10, 2010)]
    got = asof_join(spark.createDataFrame(left, L), spark.createDataFrame([("x", 3, 0, "only")], R), "k", "t", "t").collect()
    assert len(got) == 2000 and {r.found.v for r in got} == {"only"}
    assert asof_join(spark.createDataFrame([], L), spark.createDataFrame([], R), "k", "t", "t").count() == 0
    with pytest.raises(TypeError):
        asof_join(spark.createDataFrame([], L), spark.createDataFrame([], "k long, t long"), "k", "t", "t")

"""The dimension by time: versions of snapshots, matching as of a post's time, a store that a running stream follows."""

import random

import pytest

from linkloom.operators import dimension_versions as dv

DIM = "url string, article_id long, title string, section string, subsection string, tokens array<string>"


def _dim(spark, rows):
    return spark.createDataFrame([(u, a, t, None, None, [t]) for u, a, t in rows], DIM)


SNAPSHOTS = [(None, [("x", 1, "one"), ("y", 2, "two"), ("z", 3, "three")]),
             ("2024-01-10 00:00:00", [("x", 1, "one"), ("y", 2, "TWO"), ("w", 4, "four")]),
             ("2024-01-20 00:00:00", [("x", 1, "one"), ("y", 2, "two"), ("z", 3, "three"), ("w", 4, "four")])]


def _versions(spark):
    return dv.dimension_versions([(since, _dim(spark, rows)) for since, rows in SNAPSHOTS])


def test_versions_are_stretches_of_equal_rows(spark):
    got = {(r.url, r.title, r.valid_from and r.valid_from.day, r.valid_to and r.valid_to.day) for r in _versions(spark).collect()}
    assert got == {("x", "one", None, None), ("y", "two", None, 10), ("y", "TWO", 10, 20), ("y", "two", 20, None), ("z", "three", None, 10), ("z", "three", 20, None),
                   ("w", "four", 10, None)}


def test_links_match_what_held_when_they_were_posted(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice("xyzwv"), rng.choice([None, *range(1, 29)])) for n in range(300)] + [(900, "y", 10), (901, "y", 20)]
    links = spark.createDataFrame(rows, "n long, canonical_url string, day int").selectExpr("n", "canonical_url", "make_timestamp(2024, 1, day, 0, 0, 0) AS ts")
    want = set()
    for n, url, day in rows:
        if day is not None:
            state = dict((u, t) for u, _, t in SNAPSHOTS[(day >= 10) + (day >= 20)][1])
            if url in state:
                want.add((n, state[url]))
    for bound in (100, 0, 1):
        got = [(r.n, r.title) for r in dv.match_links_asof(links, _versions(spark), max_broadcast_rows=bound).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_snapshots_must_be_in_order(spark):
    one = _dim(spark, [("x", 1, "one")])
    for times in ((None, None), ("2024-02-01", "2024-01-01"), ("2024-01-01", "2024-01-01")):
        with pytest.raises(ValueError):
            dv.dimension_versions([(t, one) for t in times])


def test_store(spark, tmp_path):
    store = dv.DimensionStore(spark, str(tmp_path / "dim"))
    with pytest.raises(LookupError):
        store.versions()
    for since, rows in SNAPSHOTS:
        store.add(since, _dim(spark, rows))
        other = dv.DimensionStore(spark, store.path, max_broadcast_rows=0)  # another reader
        assert sorted(map(str, store.versions().collect())) == sorted(map(str, other.versions().collect()))
    assert sorted(map(str, store.versions().collect())) == sorted(map(str, _versions(spark).collect()))
    with pytest.raises(ValueError):
        store.add("2024-01-15 00:00:00", _dim(spark, []))
    # a snapshot whose manifest was never published is not there
    _dim(spark, [("q", 9, "never")]).write.parquet(f"{store.path}/snapshots/000000009-dead")
    assert store.versions().where("url = 'q'").count() == 0

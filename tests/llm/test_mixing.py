import re
from collections import defaultdict

import pytest

from linkloom.llm import mixing


def _targets(sizes):
    """Shares by weight; what is above three times a source's size is shared again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * unit > 3 * sizes[s] + 1e-9}
        if not above:
            target.update({s: weight[s] * unit for s in open_})
            break
        target.update({s: 3.0 * sizes[s] for s in above})
        left -= sum(target[s] for s in above)
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 1, None: 5}, {"é": 7, "z": 0, None: 900, "A": 3}, {"x": 0}, {"a": 5}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = _targets(sizes)
    assert {r.source for r in got} == set(want)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def _rows(spark, n=600):
    text = lambda i: " ".join(["w"] * (1 + i * 7 % 23))
    rows = [(i, text(i), ["a", "a", "a", "b", None, "c"][i % 6] if i % 50 else "tiny") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_mix_fills_targets(spark):
    rows, docs = _rows(spark)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()))
    by_source, sizes = defaultdict(list), {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r["size"] == sizes[r.doc_id] and r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
        by_source[source[r.doc_id]].append(r)
    want = _targets({s: sum(r["size"] for r in rs) for s, rs in by_source.items()})
    for s, rs in by_source.items():
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sum(x["size"] for x in rs) for r in rs)
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(r["size"] for r in rs)
        assert max(r.taken // r["size"] for r in rs) - min(r.taken // r["size"] for r in rs) <= 1


def test_last_documents_by_key_order(spark):
    """Those taken once more are the first in ascending key order, up to the budget."""
    rows, docs = _rows(spark, 300)
    keys = {r.id: r for r in docs.select(*mixing._keys(docs, "doc_id", "source", "text", None, mixing.SEED)).collect()}
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    for source in {s for *_, s in rows}:
        own = sorted((keys[i].key, i) for i, _, s in rows if s == source)
        copies = [got[i].taken // got[i]["size"] for _, i in own]
        assert copies == sorted(copies, reverse=True)


def test_equal_keys_go_by_id(spark):
    docs = spark.createDataFrame([(7, "w " * 4, "a")] * 10 + [(8, "w", "b")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert all(r.taken <= 3 * r["size"] for r in got) and len(got) == 11


def test_quality_weights_favour_good_documents(spark):
    rows = [(i, "plain words here" if i % 2 else "#### $$$$ %%%%", s) for s in "ab" for i in range(4000 * (s == "b"), 4000 * (1 + (s == "b")))]
    taken = {0: 0, 1: 0}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 4000").collect():
        taken[r.doc_id % 2] += r.taken
    assert taken[1] > 1.5 * taken[0] > 0


def test_mixing_hard_rows(hard, nothing, hard_rows):
    got = mixing.mix(hard).collect()
    assert sorted(r["size"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in hard_rows)
    mixed = mixing.mixed(hard)
    assert mixed.columns == hard.columns
    assert mixed.count() == sum(r.taken // r["size"] for r in got if r["size"])
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0

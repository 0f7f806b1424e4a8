import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import exact_dedup, jaccard_join, suffix_dedup
from linkloom.llm.graph import components


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _weak(c):
    return F.pmod(F.xxhash64(c), F.lit(13)).cast("long")


@pytest.mark.parametrize("hashed", [F.xxhash64, _weak])
def test_exact_duplicates(spark, hashed):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab \t") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    rows = [(i, rng.choice(pool)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, block=8, hashed=lambda c: hashed(c)).collect()}
    groups = defaultdict(list)
    for i, text in rows:
        groups[_norm(text)].append(i)
    for i, text in rows:
        own = groups[_norm(text)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(own), len(own), i == min(own))
        assert got[i].text_sha256 == hashlib.sha256(_norm(text).encode()).hexdigest()


def test_exact_duplicates_hard_rows(hard, nothing, hard_rows):
    got = exact_dedup.exact_duplicates(hard).collect()
    assert len(got) == len(hard_rows)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    assert len(by_text) == len({_norm(r[1]) for r in hard_rows})
    for rows in by_text.values():
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)}
        assert {r.keep_id for r in rows} == {min(ids) if ids else None}
    kept = exact_dedup.deduplicated(hard)
    assert kept.columns == hard.columns and kept.count() == len(by_text)
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.deduplicated(nothing).count() == 0


def _components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def _near(rows, width, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, _components(sets, links)


@pytest.mark.parametrize("width,percent,region", [(4, 85, {}), (5, 80, {}), (2, 50, {"region_docs": 3, "region_shingles": 50})])
def test_jaccard_join(spark, families, width, percent, region):
    sizes, comp = _near(families, width, percent)
    docs = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    got = jaccard_join.near_duplicates(docs, width=width, percent=percent, **region).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], comp[i]) for i in sizes}
    assert len(set(comp.values())) < len(comp)


def test_jaccard_cells_are_never_too_few():
    """Linked sets share at least as many cells as either needs."""
    rng = random.Random(8)
    sizes = jaccard_join.Sizes(85)
    for _ in range(150):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 4, 5, 8, 13, 40, 200, 900]))]
        b = list(a)
        for _ in range(rng.randint(0, 2 + len(a) // 30)):
            b[rng.randrange(len(b))] = f"v{rng.randrange(10**6)}"
        texts = [" ".join(a).encode(), " ".join(b).encode()]
        doc, h = jaccard_join.shingle_sets(texts, 4)
        x, y = set(h[doc == 0].tolist()), set(h[doc == 1].tolist())
        if 100 * len(x & y) < 85 * len(x | y) or x == y:
            continue
        one, two = jaccard_join.describe(texts, 0, sizes, set(), 4)
        best = max((len(set(p["cells"].tolist()) & set(q["cells"].tolist())) - max(p["need"], q["need"]) for p in one["cells"] for q in two["cells"] if p["region"] == q["region"]), default=-1)
        assert best >= 0


def test_near_cells_are_shuffled_in_passes(spark, monkeypatch):
    """No write of cells leaves more than a part of all their rows in shuffle files at once, and the result is that of all pairs."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows = []
    for family in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 400]))]
        for _ in range(rng.choice([1, 3])):
            text = list(base)
            text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    shuffled, write = [], jaccard_join.written_at

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f: os.path.getsize(f) for f in found if f.endswith(".data") and os.path.exists(f)}

    def measured(df, name):
        before = files()
        out = write(df, name)
        if name.startswith("jaccard-cells"):
            shuffled.append(sum(size for f, size in files().items() if f not in before))
        return out

    monkeypatch.setattr(jaccard_join, "written_at", measured)
    monkeypatch.setattr(jaccard_join, "PASS_SHINGLES", 0, raising=False)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(shuffled) > 100_000 and max(shuffled) < 0.4 * sum(shuffled)
    sizes, comp = _near(rows, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], comp[i]) for i in sizes}


def test_region_join_skips_only_what_the_triangle_inequality_allows():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.integers(0, 2**60, 60).astype(np.uint64)
        sets = []
        for _ in range(12):
            s = base.copy()
            k = rng.integers(0, 25)
            s[rng.choice(60, k, replace=False)] = rng.integers(0, 2**60, k).astype(np.uint64)
            sets.append(np.unique(s))
        links = [(i, j) for i in range(12) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        want = _components(range(12), links)
        got = jaccard_join.join_sets(sets, rng.permutation(12), 80)
        assert len({(want[i], got[i]) for i in range(12)}) == len(set(want.values())) == len(set(got.tolist()))


def test_jaccard_hard_rows(hard, nothing, hard_rows):
    got = jaccard_join.near_duplicates(hard).collect()
    assert len(got) == len(hard_rows)
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert rows[(0, 0)] == 0 and rows[(1, 0)] == 1 and rows[(5, 1)] == 4 and rows[(7, 2)] == 6 and rows[(None, 1)] == 3
    kept = jaccard_join.deduplicated(hard)
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").distinct().collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 8, 9, 10, 11]
    assert jaccard_join.near_duplicates(nothing).count() == 0 and jaccard_join.deduplicated(nothing).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 230)] + [(5, 5), (300, 301), (301, 302), (302, 300)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _components({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    assert got.keys() == want.keys()
    assert len({(want[i], got[i]) for i in want}) == len(set(want.values())) == len(set(got.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _repeats(rows, length):
    seen, out = set(), {}
    for key, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        runs = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(data) else 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[key] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [4096, 3])
def test_suffix_repeats(spark, group, monkeypatch):
    rng = random.Random(group)
    pool = ["".join(rng.choice("abé ") for _ in range(rng.randint(10, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 7)))) for i in range(120)]
    rows += [(200, "ab" * 300), (201, "b" + "ab" * 50), (202, "a" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.without_repeats(docs, length=24, anchor=8, node=5, group=group).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == _repeats(rows, 24)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_pieces_of_long_documents(monkeypatch):
    """Documents cut into overlapping pieces have every window exactly once."""
    monkeypatch.setattr(suffix_dedup, "BUFFER", 50)
    data = bytes(range(256))
    seen = []
    for keys, buffer, bounds in suffix_dedup._pieces(iter([((1,), data), ((2,), b"short")]), 24):
        for (doc, base), a, b in zip(keys, bounds[:-1], bounds[1:]):
            seen += [(doc, base + i, buffer[a + i : a + i + 24]) for i in range(b - a - 23)]
    assert seen == [(1, i, data[i : i + 24]) for i in range(len(data) - 23)]


def test_suffix_hard_rows(hard, nothing, hard_rows):
    ids = defaultdict(int)
    rows = []
    for doc, text in sorted(((r[0], r[1]) for r in hard_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        rows.append(((-1 if doc is None else doc, ids[doc]), text or ""))
        ids[doc] += 1
    got = suffix_dedup.without_repeats(hard, keep_text=False).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(_repeats(rows, 100).values())
    assert suffix_dedup.without_repeats(nothing).count() == 0


def _stay(rows, width=5, percent=80):
    """Rows (id, text) that near de-duplication keeps, by comparing all pairs: of each component the smallest id that is not null, and of the rows
    that have it one."""
    sizes, comp = _near([(k, t) for k, (_, t) in enumerate(rows)], width, percent)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[comp[k] if sizes[k] else ("blank", k)].append(rows[k])
    return [sorted(g, key=lambda r: (r[0] is None, r[0] or 0))[0][0] for g in groups.values()], groups


A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
B, C = "a quite different text which has no copy at all in this table", "and a third one of which there is no copy here either"


@pytest.mark.parametrize("rows", [
    [(1, A), (None, A + " more"), (None, B), (2, C)],
    [(1, A), (5, A + " more"), (5, B), (2, C)],
    [(5, A), (5, A + " more"), (7, B)],
    [(5, A), (5, A), (5, A + " more"), (None, A), (None, None), (None, None), (3, ""), (3, " ")],
    [(None, A), (None, A + " more"), (None, A + " more"), (None, B)],
])
def test_near_copies_go_row_by_row(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in jaccard_join.deduplicated(docs).collect()]
    ids, groups = _stay(rows)
    assert sorted(str(i) for i, _ in got) == sorted(map(str, ids))
    assert all(sum(got.count(r) for r in set(g)) == 1 for k, g in groups.items() if not isinstance(k, tuple))


def test_repeated_passages_under_text_ids(spark):
    """Ids of any kind order as they sort: the first in that order keeps the passage; null ids come first, and rows that share an id stay apart."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(160))
    rows = [("b9", "x" + passage), ("b10", passage + "y"), ("b10", "z" + passage + "!"), (None, None), ("a", "nothing that comes again"), ("ü", passage)]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), keep_text=True).collect()
    kept = sorted((str(r.doc_id), r.kept.decode(), r.n_removed) for r in got)
    assert kept == sorted([("b9", "x", 160), ("b10", passage + "y", 0), ("b10", "z!", 160), ("None", "", 0), ("a", "nothing that comes again", 0), ("ü", "", 160)])

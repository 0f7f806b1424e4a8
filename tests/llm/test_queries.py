"""The registered queries against their SQL, and the pipeline stage by stage."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from linkloom.llm import mixing, queries, toxicity
from linkloom.llm.common import written


def _near(rows, width, percent):
    """Set sizes and components by comparing all pairs."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                comp[max(root(a), root(b))] = min(root(a), root(b))
    return {i: len(s) for i, s in sets.items()}, {i: root(i) for i in sets}


def _same(rows, want):
    names = sorted(want[0].keys()) if want else []
    key = lambda r: tuple(str(r[n]) for n in names)
    return sorted(map(key, rows)) == sorted(map(key, want))


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    table = con.sql(queries.ORACLE[name]).arrow()
    table = table.read_all() if hasattr(table, "read_all") else table
    assert _same([r.asDict() for r in queries.QUERIES[name](spark, sf_small).collect()], table.to_pylist())


def _stages(spark, docs, sf_dir, name):
    tables = {}
    for stage, function in corpus_pipeline.STAGES:
        tables[stage] = (docs, docs := written(function(spark, docs, sf_dir), f"{name}-{stage}"))
    return tables


def _rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def _distinct(rows):
    """What exact de-duplication keeps: of equal texts, white space aside, the smallest id (null ids last)."""
    groups = defaultdict(list)
    for doc, text in rows.elements():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    return {t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in groups.items()}


def _check_stages(spark, tables, labels):
    for name, (before, after) in list(tables.items())[:-1]:
        assert after.columns == before.columns
    before, after = tables["toxicity"]
    scored = toxicity.score_toxicity(before.select("doc_id", "text").distinct(), labels).withColumnRenamed("doc_id", "i").collect()
    rejected = {t for (i, t) in _rows(before) if any(r.predicted for r in scored if r.i == i) and list(r.i for r in scored).count(i) == 1}
    assert not rejected & {t for _, t in _rows(after)} and not _rows(after) - _rows(before)
    assert all(t in rejected or _rows(before)[(i, t)] == _rows(after)[(i, t)] for i, t in _rows(before) if [r.i for r in scored].count(i) == 1)

    before, after = (_rows(x) for x in tables["exact_dedup"])
    want = _distinct(before)
    assert sum(after.values()) == len(want) and not after - before
    assert {re.sub(r"[\x20\x09-\x0D]+", " ", t or ""): i for i, t in after} == want

    before, after = (_rows(x) for x in tables["near_dedup"])
    rows = list(before.elements())
    sizes, comp = _near([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    groups = defaultdict(list)
    for k, row in enumerate(rows):
        groups[comp[k] if sizes[k] else ("blank", k)].append(row)
    assert sum(after.values()) == len(groups) and not after - before
    for g in groups.values():
        kept = [r for r in after for x in [r] if x in g]
        assert len(kept) == 1 and kept[0][0] == min(g, key=lambda r: (r[0] is None, r[0] or 0))[0]

    before, after = tables["mixing"]
    taken = Counter()
    for r in mixing.mix(before).collect():
        taken[r.doc_id] += r.taken // r["size"] if r["size"] else 0
    assert +taken == Counter(r.doc_id for r in after.collect())

    before, after = tables["bpe"]
    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    ids = [library.encode(r.text or "", add_special_tokens=False).ids for r in before.collect()]
    assert Counter(map(tuple, ids)) == Counter(tuple(r.token_ids) for r in after.collect())
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.token_ids)).encode()).hexdigest() and r.n_tokens == len(r.token_ids) for r in after.collect())


def test_pipeline_stages_against_brute_force(spark, sf_small):
    tables = _stages(spark, spark.read.parquet(f"{sf_small}/documents.parquet"), sf_small, "test")
    _check_stages(spark, tables, spark.read.parquet(f"{sf_small}/labels.parquet"))


def test_pipeline_over_hard_rows(spark, hard, sf_small):
    tables = _stages(spark, hard, sf_small, "test-hard")
    _check_stages(spark, tables, spark.read.parquet(f"{sf_small}/labels.parquet"))

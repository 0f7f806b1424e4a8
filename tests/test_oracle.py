"""Every named query against its DuckDB oracle on the smallest scale (row count, columns, value hash)."""

import pytest

from __spark_entry__ import oracle_sql, queries
from linkloom.plans.queries import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck(sf_small):
    import tools.compare as C
    return C.duck(sf_small)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, duck, name):
    import tools.compare as C
    df = queries()[name](spark, sf_small)
    srows = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    assert sql is not None, f"{name} has no oracle"
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert C.digest(df.columns, srows)[0] == C.digest(dcols, drows)[0]


def test_entry_contract(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() >= 0
    assert df.columns == ["entry_id", "uri", "author_did", "ts", "text", "url_ord", "url", "article_id", "title",
                          "labels", "n_labels"]

"""J1/A1 lookup, active authors (A2/A3/J3/J4), categories (A4), label tokens."""

from pyspark.sql import functions as F

from linkloom.operators import articles as art
from linkloom.operators.authors import active_authors, order_active_authors
from linkloom.operators.categories import distinct_categories


def dims(spark):
    articles = spark.createDataFrame([
        (1, "https://www.x.com/1", "opinion", "", "T1"),
        (2, "https://www.x.com/2", "opinion", "politics", None),
        (3, "https://www.x.com/3", "US", "Politics", ""),
        (4, "https://www.x.com/4", "us", "politics", "T4"),
        (5, "https://www.x.com/5", "Opinion", "   ", "T5"),
        (6, "https://www.x.com/6", "travel", "review", "T6"),
        (7, "https://www.x.com/7", "", None, "T7"),
    ], "id long, url string, section string, subsection string, title string")
    authors = spark.createDataFrame([(10, "Rhea Dunn"), (11, "Jorah Bell"), (12, "Rare Writer"),
                                     (13, "  "), (14, "Rhea Dunn"), (15, "Rhea  Dunn")],
                                    "id long, name string")
    bridge = spark.createDataFrame([(1, 10), (2, 10), (5, 10), (3, 11), (4, 11), (6, 11), (1, 12), (5, 12),
                                    (6, 13), (6, 14), (6, 15), (9, 12), (7, 99)],
                                   "article_id long, author_id long")
    return articles, authors, bridge


def test_active_authors(spark):
    a, au, b = dims(spark)
    rows = order_active_authors(active_authors(a, b, au)).collect()
    # Rhea: 2 'opinion' (case-sensitive; 'Opinion' does not count); Jorah: 2 us/politics (any case)
    # Rare Writer: 1 opinion only. Totals count every article of the author.
    assert [(r.id, r.name, r.total_articles) for r in rows] == [(11, "Jorah Bell", 3), (10, "Rhea Dunn", 3)]


def test_article_lookup(spark):
    a, au, b = dims(spark)
    out = {r.id: r for r in art.article_lookup(a, b, au).collect()}
    assert out[1].authors == ["Rhea Dunn", "Rare Writer"]
    assert out[1].subsection is None and out[3].title is None and out[2].title is None
    # blank names dropped, duplicate names folded onto the first author id, order = author id
    assert out[6].authors == ["Jorah Bell", "Rhea Dunn", "Rhea  Dunn"]
    assert out[7].authors == []


def test_tokens(spark):
    a, au, b = dims(spark)
    slugs = art.active_slugs(active_authors(a, b, au))
    dim = {r.article_id: r.tokens for r in art.label_dimension(a, b, au, slugs).collect()}
    assert dim[1] == ["opinion", "rhea-dunn"]
    assert dim[2] == ["opinion", "politics", "rhea-dunn"]
    assert dim[3] == ["us", "politics", "jorah-bell"]
    assert dim[5] == ["opinion", "rhea-dunn"]          # blank subsection skipped
    # two spellings with the same slug both label (no dedupe across tokens)
    assert dim[6] == ["travel", "review", "jorah-bell", "rhea-dunn", "rhea-dunn"]
    assert dim[7] == []


def test_match_and_unmatched(spark):
    a, au, b = dims(spark)
    dim = art.label_dimension(a, b, au, art.active_slugs(active_authors(a, b, au)))
    links = spark.createDataFrame([("p1", 0, "http://x.com/1?utm=1"), ("p1", 1, "https://x.com/1"),
                                   ("p2", 0, "https://x.com/404")], "uri string, url_ord int, url string")
    m = art.match_links(links, dim).select("uri", "url_ord", "article_id").orderBy("uri", "url_ord").collect()
    assert [(r.uri, r.url_ord, r.article_id) for r in m] == [("p1", 0, 1), ("p1", 1, 1)]
    u = art.unmatched_links(links, dim).collect()
    assert [(r.uri, r.canonical_url) for r in u] == [("p2", "https://www.x.com/404")]


def test_distinct_categories(spark):
    a = spark.createDataFrame([("travel", "politics"), ("us", "us"), ("US", None), ("Us", "politics"), ("", "")],
                              "section string, subsection string")
    rows = distinct_categories(a).orderBy("family", "ord").collect()
    assert [(r.family, r.ord, r.name) for r in rows] == [
        ("section", 1, "US"), ("section", 2, "travel"), ("subsection", 1, "politics"), ("subsection", 2, "US")]

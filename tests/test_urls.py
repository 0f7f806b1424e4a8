"""P5 domain predicate, F1 canonical URL and L3 text links — golden vectors."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical_url, is_domain_url, text_links

D = "gazette.example"

DOMAIN_CASES = [
    # host equal to the domain, or below it
    ("https://gazette.example/weather", True),
    ("http://gazette.example", True),
    ("https://a.b.c.gazette.example/deep?q=1#f", True),
    ("hTTpS://Sport.GAZETTE.example/", True),
    # the domain elsewhere in the URL, or as the end of another label
    ("https://xgazette.example/", False),
    ("https://gazette.example.net/", False),
    ("https://other.example/gazette.example", False),
    ("https://other.example/?u=https://gazette.example/", False),
    # other schemes, no URL at all
    ("gopher://gazette.example/1", False),
    ("gazette.example/weather", False),
    ("plain words", False),
    ("", False),
    (None, False),
    # userinfo, ports
    ("https://gazette.example@mirror.example/x", False),
    ("https://mirror.example@gazette.example/x", True),
    ("https://gazette.example:70000/", False),
    ("https://gazette.example:8443/x", True),
    # spaces, backslashes, percent-encoded and compatibility characters in the host
    ("https://gaz ette.example/x", False),
    ("\t https://gazette.example/x \n", True),
    ("http:\\\\gazette.example\\a", True),
    ("https://g%61zette.example/x", True),
    ("https://\uff47\uff41\uff5a\uff45\uff54\uff54\uff45.example/x", True),
    ("https://gazette\u3002example/x", True),
    ("https://g%zzazette.example/x", False),
    ("https://gazette%FF.example/x", False),
    ("https://%5B::1%5D/x", False),
    ("https://[::1]/x", False),
]

CANONICAL_CASES = [
    # scheme and host
    ("http://gazette.example/city/budget-vote", "https://www.gazette.example/city/budget-vote"),
    ("https://gazette.example/city/budget-vote", "https://www.gazette.example/city/budget-vote"),
    ("https://www.gazette.example/city/", "https://www.gazette.example/city/"),
    ("https://sport.gazette.example/cup", "https://www.sport.gazette.example/cup"),
    ("HTTPS://WWW.Gazette.EXAMPLE/Mixed/Case", "https://www.gazette.example/Mixed/Case"),
    # query and fragment go, also without a path
    ("https://www.gazette.example/a?from=mail&n=2#notes", "https://www.gazette.example/a"),
    ("http://gazette.example?x=1", "https://www.gazette.example/"),
    ("http://gazette.example#top", "https://www.gazette.example/"),
    # what is no URL comes back trimmed
    ("  two words ", "two words"),
    ("words-with-hyphens", "words-with-hyphens"),
    # ports
    ("http://gazette.example:80/a", "https://www.gazette.example/a"),
    ("http://gazette.example:443/a", "https://www.gazette.example/a"),
    ("https://gazette.example:80/a", "https://www.gazette.example:80/a"),
    ("https://gazette.example:00081/a", "https://www.gazette.example:81/a"),
    # percent-encoding and dot segments
    ("https://gazette.example/one two", "https://www.gazette.example/one%20two"),
    ("https://gazette.example/ü", "https://www.gazette.example/%C3%BC"),
    ("https://gazette.example/x/./y/../z", "https://www.gazette.example/x/z"),
    ("https://gazette.example/x/y/..", "https://www.gazette.example/x/"),
    ("https://gazette.example/..", "https://www.gazette.example/"),
    # userinfo, backslashes, encoded and compatibility hosts
    ("https://me:secret@gazette.example/x", "https://me:secret@www.gazette.example/x"),
    ("https://me:@gazette.example/x", "https://me@www.gazette.example/x"),
    ("http:\\\\gazette.example\\x\\y", "https://www.gazette.example/x/y"),
    ("https://GAZ%45TTE.example/x", "https://www.gazette.example/x"),
    ("https://\uff27\uff21\uff3aette.example/x", "https://www.gazette.example/x"),
    ("https://a%zz.example/x", "https://a%zz.example/x"),
    ("https://a+b.example/x", "https://www.a+b.example/x"),
    # addresses get no www
    ("http://[::1]:8080/x", "https://[::1]:8080/x"),
    ("http://10.0.0.1/x", "https://10.0.0.1/x"),
    ("http://a.123/x", "http://a.123/x"),
    ("http://www.1.2.3.4/x", "http://www.1.2.3.4/x"),
    # other schemes keep theirs and lose query and fragment
    ("mailto:desk@gazette.example?subject=hi", "mailto:desk@gazette.example"),
    ("News:item#3", "news:item"),
    ("foo://bar/x?y", "foo://www.bar/x"),
    ("foo://www.bar:09/x y", "foo://www.bar:9/x%20y"),
    ("foo://a b/x?y", "foo://a b/x?y"),
]


def _one(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r.o for r in df.select("i", fn.alias("o")).orderBy("i").collect()]


def test_domain_predicate(spark):
    got = _one(spark, [c for c, _ in DOMAIN_CASES], is_domain_url("u", D))
    assert got == [e for _, e in DOMAIN_CASES]


def test_canonical_url(spark):
    got = _one(spark, [c for c, _ in CANONICAL_CASES], canonical_url("u"))
    assert got == [e for _, e in CANONICAL_CASES]


def test_canonical_url_null(spark):
    assert _one(spark, [None], canonical_url("u")) == [None]


@pytest.mark.parametrize("text,expected", [
    ("see https://www.gazette.example/a/b. and more", ["https://www.gazette.example/a/b."]),
    ("two https://gazette.example/1 https://gazette.example/2", ["https://gazette.example/1", "https://gazette.example/2"]),
    ("HTTP://x.GAZETTE.example/q?z=1 upper", ["HTTP://x.GAZETTE.example/q?z=1"]),
    ("two labels https://a.b.gazette.example/no", []),
    ("bare host https://gazette.example/ end", []),
    ("port https://gazette.example:443/x", []),
    ('quoted "https://gazette.example/q"x', ["https://gazette.example/q"]),
    ("nbsp https://gazette.example/a\u00a0tail", ["https://gazette.example/a"]),
    ("ideographic https://gazette.example/b\u3000tail", ["https://gazette.example/b"]),
    ("no link here", []),
])
def test_text_links(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(text_links(F.col("t"), D).alias("m")).first().m == expected

"""F2 slug, F3 fold, F4 display name and the report helpers F6–F14."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as T


def _map(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("value,expected", [
    ("Oil, gas + WIND!", "oil-gas-wind"),
    ("a1 B2\tc3", "a1-b2-c3"),
    ("...trim me...", "trim-me"),
    ("Zoë Ó Briain", "zoe-o-briain"),
    ("İstanbul ß", "istanbul"),
    ("Søren Ægir", "s-ren-gir"),
    ("ǖber Ångström", "uber-angstrom"),
    ("東京", ""),
    ("  ", ""),
])
def test_slugify(spark, value, expected):
    assert _map(spark, [value], T.slugify) == [expected]


def test_slugify_matches_python_nfd(spark):
    import unicodedata
    samples = ["Crème brûlée", "Ærøskøbing", "Žluťoučký kůň", "naïve café", "Ǆemal", "Ωmega 12", "ḟoo"]

    def ref(s):
        import re
        d = unicodedata.normalize("NFD", s.lower())
        d = re.sub("[\u0300-\u036f]", "", d)
        return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", d))
    assert _map(spark, samples, T.slugify) == [ref(s) for s in samples]


def test_accent_table_rule():
    src, dst = T.accent_table()
    assert len(src) == len(dst) == 489


def test_fold_and_display(spark):
    assert _map(spark, ["us", "Us", "US", "uS", "travel"], T.fold_category) == ["US", "US", "US", "US", "travel"]
    assert _map(spark, ["us", "Us", "US", "politics", "", "Science & Technology"], T.display_name) == \
        ["US", "US", "US", "Politics", "", "Science & Technology"]


def test_report_helpers(spark):
    assert _map(spark, ["sub-x", "review", "rhea-dunn", "opinion"], T.tag_class) == ["sub", "sub", "author", "plain"]
    assert _map(spark, ["us", "US", "opinion"], T.tag_display) == ["US", "US", "opinion"]
    assert _map(spark, ["<a href='x'>&\"</a>"], T.html_escape) == ["&lt;a href=&#039;x&#039;&gt;&amp;&quot;&lt;/a&gt;"]
    assert _map(spark, ["a b!~*'()é+&"], T.encode_uri_component) == ["a%20b!~*'()%C3%A9%2B%26"]
    assert _map(spark, [None, "", "T"], T.title_default) == ["Unknown Title", "Unknown Title", "T"]


def test_uptime_and_age(spark):
    df = spark.createDataFrame([(0,), (59,), (3661,), (400000,)], "s long")
    assert [r.o for r in df.select(T.format_uptime(F.col("s")).alias("o")).collect()] == \
        ["00:00:00", "00:00:59", "01:01:01", "111:06:40"]
    rows = spark.createDataFrame([("2024-01-01T00:00:00.000Z",), ("2023-12-31T23:58:55.500Z",), (None,), ("junk",),
                                  ("2024-01-01T00:00:09.000Z",)], "t string")
    at = F.lit("2024-01-01 00:00:05").cast("timestamp")
    got = [r.o for r in rows.select(T.relative_age(F.col("t"), at).alias("o")).collect()]
    assert got == ["5s ago", "1m 9s ago", "Never", "-", "0s ago"]


def test_feed_status(spark):
    df = spark.createDataFrame([(True, 0), (False, 2), (False, 0)], "c boolean, r int")
    assert [r.o for r in df.select(T.feed_status(F.col("c"), F.col("r")).alias("o")).collect()] == \
        ["Online", "Connecting", "Offline"]

"""Property tests: slug against a Python NFD reference; canonical URL idempotence; domain predicate
invariance under case and spoofing."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions.text import slugify
from linkloom.functions.urls import canonical_url, is_domain_url

ALPHABET = st.sampled_from(
    [chr(c) for c in range(0x20, 0x7F)] + [chr(c) for c in range(0xC0, 0x180)]
    + [chr(c) for c in range(0x300, 0x370)] + [chr(c) for c in range(0x1E00, 0x1E30)] + [" ", "ß", "ø", "東"])


def py_slug(s: str) -> str:
    d = unicodedata.normalize("NFD", s.lower())
    d = re.sub("[\u0300-\u036f]", "", d)
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", d))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=200, max_size=200))
def test_slug_matches_nfd_reference(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in df.select("i", slugify(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [py_slug(t) for t in texts]


LABEL = st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789-", min_size=1, max_size=8)
PATH = st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789-._~/%é ", max_size=20)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["http", "https", "HTTP", "ftp"]), st.lists(LABEL, max_size=2),
                          st.sampled_from(["example.com", "example.org", "EXAMPLE.com"]),
                          st.sampled_from(["", ":80", ":443", ":8080"]), PATH,
                          st.sampled_from(["", "?q=1", "#f", "?a#b"])), min_size=150, max_size=150))
def test_canonical_idempotent_and_domain_case_invariant(spark, parts):
    urls = [f"{s}://{'.'.join(labels + [host])}{port}/{path}{tail}" for s, labels, host, port, path, tail in parts]
    df = spark.createDataFrame([(i, u, u.upper()) for i, u in enumerate(urls)], "i int, u string, up string")
    out = (df.select("i", "u", canonical_url("u").alias("c"), is_domain_url("u", "example.com").alias("d"),
                     is_domain_url("up", "example.com").alias("d_up"))
           .withColumn("cc", canonical_url("c")).orderBy("i").collect())
    for r, (scheme, labels, host, _, _, _) in zip(out, parts):
        assert r.cc == r.c                       # canonical form is a fixed point
        assert r.d == r.d_up                     # scheme and host are case-insensitive
        expected = scheme.lower() in ("http", "https") and host.lower() == "example.com"
        assert r.d == expected
        if r.d:
            assert r.c.startswith("https://www.") and "?" not in r.c and "#" not in r.c

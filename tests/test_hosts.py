"""International hosts against Python's own punycode codec, numeric hosts against a model of the address rules."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import hosts
from linkloom.functions.urls import canonical_url, is_domain_url


def _column(spark, values, sql):
    return [r[1] for r in spark.createDataFrame(list(enumerate(values)), "n int, v string").select("n", F.expr(sql).alias("x")).orderBy("n").collect()]


def test_punycode_equals_the_codec(spark):
    rng = random.Random(6)
    alphabets = ["aäöüß", "abcčš-09é", "漢字かなカナ", "αβγabc", "мир", "😀a🚀", "aé漢😀ω"]
    labels = ["bücher", "ü", "münchen", "例え", "éa", "aé"] + ["".join(rng.choice(a) for _ in range(rng.randint(1, 30))) for a in alphabets for _ in range(40)]
    labels = [x for x in labels if not x.isascii()]
    assert _column(spark, labels, hosts.punycode_sql("v")) == [x.encode("punycode").decode() for x in labels]


def _address(host):
    parts = host[:-1].split(".") if host.endswith(".") else host.split(".")
    if len(parts) > 4:
        return None
    values = []
    for p in parts:
        try:
            if p[:2] in ("0x", "0X"):
                values.append(int(p[2:], 16) if p[2:] else 0)
            elif len(p) > 1 and p[0] == "0":
                values.append(int(p[1:], 8))
            elif p.isdigit():
                values.append(int(p))
            else:
                return None
        except ValueError:
            return None
    if any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
        return None
    n = sum(v * 256 ** (3 - i) for i, v in enumerate(values[:-1])) + values[-1]
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def test_addresses_equal_the_model(spark):
    rng = random.Random(9)

    def number(top):
        v = rng.choice([0, 1, 7, 8, 127, 255, 256, 65535, 65536, top, top + 1, rng.randint(0, top)])
        return rng.choice([str(v), hex(v), f"0X{v:X}", f"0{v:o}", f"000{v:o}", f"0x000{v:x}"])

    given = ["0x", "0x.0x", "08", "1.2.3.08", "256", "4294967295", "4294967296", "99999999999999999999", "0xffffffffff", "1.2.3.4.", "1.2.3.4.5", "0177.1", "1..2", "0x7f.1"]
    given += [".".join(number(255 if k else 256 ** 4) for k in range(rng.randint(1, 5))) for _ in range(300)]
    assert _column(spark, given, hosts.ipv4_sql(hosts.ipv4_parts_sql("v"))) == [_address(h) for h in given]


CASES = {
    "http://BÜCHER.example/Ü": "https://www.xn--bcher-kva.example/%C3%9C",
    "https://www.bücher.example:444/?q#f": "https://www.xn--bcher-kva.example:444/",
    "https://faß.example/": "https://www.xn--fa-hia.example/",
    "https://b%C3%BCcher.example/x": "https://www.xn--bcher-kva.example/x",
    "https://ex­am​ple.com/": "https://www.example.com/",
    "https://例え.テスト/a": "https://www.xn--r8jz45g.xn--zckzah/a",
    "http://0x7f.1/a": "https://127.0.0.1/a",
    "http://2130706433/": "https://127.0.0.1/",
    "http://0300.0250.0.1:8080/x": "https://192.168.0.1:8080/x",
    "http://1.2.3/": "https://1.2.0.3/",
    "http://192.168.0.257/": "http://192.168.0.257/",
    "http://1.2.3.4.5/": "http://1.2.3.4.5/",
    "http://0x1g.1.8/": "http://0x1g.1.8/",
    "http://a b.example/": "http://a b.example/",
}


def test_canonical_urls_of_such_hosts(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "n int, u string")
    got = rows.select("n", canonical_url("u").alias("c")).orderBy("n").collect()
    assert [r.c for r in got] == list(CASES.values())


@pytest.mark.parametrize("domain,inside,outside", [("bücher.example", [], []), ("xn--bcher-kva.example", ["https://bücher.example/", "http://m.BÜCHER.example/x"],
                                                                                        ["https://bucher.example/", "https://bücher.example.org/"])])
def test_domain_predicate(spark, domain, inside, outside):
    rows = spark.createDataFrame([(u,) for u in inside + outside] or [("https://x/",)], "u string")
    found = {r.u for r in rows.where(is_domain_url("u", domain)).collect()}
    assert found == set(inside)

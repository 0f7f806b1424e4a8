import hashlib
import re

from linkloom.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    "write to joe.doe@mail.example.com or a@b, a@b.c_d@e.f x@y.z.", "1.2.3.4 1.2.3.4.5 256.1.1.1 01.002.3.4 1.2.3 9.9.9.9.9.9.9.9",
    "4111 1111 1111 1111, 4111-1111-1111-1112; 378282246310005 and 1234567", "call +1 (234) 555-0199 or +49 30 1234567- or +1 2, ++44 20 7946 0958",
    "é漢\U0001F600 café@x.example \U0001F600 10.0.0.1 \U0001F600", "", "no data at all", "a" * 20000 + "@x.example " + "1" * 20000 + " " + "1.1." * 3000 + " +" + "1 " * 5000,
    "IBAN DE89 3704 0044 0532 0130 00 or DE88370400440532013000 or GB82WEST12345698765432", "ssn 123-45-6789; now comes a long stretch of words that have nothing to do with it: 123-45-6789 and more",
    "tel 555-123-4567", "order 555-123-4567 shipped",
]


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _base(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.digest(pii.find_pii(docs)).collect():
        want = _base(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r.doc_id, r.spans, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        assert set(want) <= set(r.spans.split(","))


def test_ibans_end_where_their_country_says(spark):
    valid = {"DE": "DE89370400440532013000", "GB": "GB82WEST12345698765432", "FR": "FR1420041010050500013M02606", "NO": "NO9386011117947", "BE": "BE68539007547034", "MT": "MT84MALT011000012345MTLCAST001S"}
    spaced = lambda x: " ".join(x[i:i + 4] for i in range(0, len(x), 4))
    texts = [form(x) + tail for x in valid.values() for form in (str, spaced) for tail in (" BIC COBADEFF", " AND SO ON", " 12 34", ", B", "")]
    found = {r.doc_id: [texts[r.doc_id][s.start:s.end].replace(" ", "") for s in r.spans if s.kind == "iban"]
             for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(found[i] == [x] for i, x in enumerate(x for x in valid.values() for _ in range(10)))
    wrong = ["DE8937040044053201300", "DE893704004405320130001", "ZZ89370400440532013000", "xDE89370400440532013000", "DE88370400440532013000"]
    assert not any(s.kind == "iban" for r in pii.find_pii(spark.createDataFrame(list(enumerate(wrong)), "doc_id long, text string")).collect() for s in r.spans)


def test_added_kinds_need_checksum_or_context(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    kinds = {r.doc_id: [TEXTS[r.doc_id][s.start:s.end] for s in r.spans if s.kind not in pii.BASE] for r in pii.find_pii(docs).collect()}
    assert kinds[8] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert len(kinds[9]) == 1 and kinds[10] == ["555-123-4567"] and kinds[11] == []


def test_many_matches_have_right_places(spark):
    text = " ".join(f"u{i}@host.example" for i in range(1500))
    spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).head().spans
    assert [text[s.start:s.end] for s in spans] == text.split(" ")


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é joe@x.example, 10.0.0.1."), (2, None), (3, "plain")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in pii.redact(docs, pii.find_pii(docs)).collect()}
    assert rows == {1: "é [email], [ip].", 2: "", 3: "plain"}


def test_pii_hard_rows(hard, nothing, hard_rows):
    got = pii.digest(pii.find_pii(hard)).collect()
    assert sorted(r.base_sha256 for r in got) == sorted(hashlib.sha256(",".join(_base(r[1] or "")).encode()).hexdigest() for r in hard_rows)
    assert pii.digest(pii.find_pii(nothing)).count() == 0

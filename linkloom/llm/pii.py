"""Personal data: patterns propose spans, checksums and ranges confirm them, context words adjust the score.

Per kind a regular expression proposes spans from left to right; the kind's check (digit counts, Luhn, mod 97, ranges)
drops those that fail. Spans get a score: what the kind is worth once confirmed, plus what a context word of the
kind in the ``CONTEXT`` code points around it adds. The four base kinds are always reported; the added kinds are
reported from ``THRESHOLD`` on: an IBAN on its checksum alone, a local phone or national number only beside a word that
speaks for it.

Everything is a column expression: positions come from the lengths of the pieces between the matches, in code points,
end exclusive. Patterns are possessive and anchored at the start of a run, so that long runs cost linear time and no
deep recursion. There is no shuffle.

Defined cases: a null text is empty and has no spans; each row stands for itself, repeated or not; other columns
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import as_text

CONTEXT = 40
THRESHOLD = 0.5
_CHUNK = 256

_LOCAL = "[A-Za-z0-9._%+-]"
# The countries of the published registry by the length of their IBANs.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# every country has one length: what follows an IBAN, capitals or digits after a space, is not taken for a part of it
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items())
#: kind -> pattern, in the order of the report. The first four are the base kinds.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a confirmed span is worth, and what a context word adds.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.7, 0.3),
          "iban": (0.8, 0.2), "local_phone": (0.3, 0.4), "national_id": (0.3, 0.5)}
CONTEXT_WORDS = {
    "email": "mail|contact|write to|schreib|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": "card|visa|master|amex|karte|carte|tarjeta|credit",
    "phone": r"phone|\btel\b|call|fax|mobile|telefon|tel[eé]fono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "local_phone": r"phone|\btel\b|call|fax|mobile|telefon|tel[eé]fono",
    "national_id": r"\bssn\b|social security|national id|passport|ausweis",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))

    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def _always(m: Column) -> Column:
    return F.lit(True)


def _octets(m: Column) -> Column:
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return m.rlike(rf"^{byte}(?:\.{byte}){{3}}$")


CONFIRM = {
    "email": _always,
    "ip": _octets,
    "card": lambda m: F.length(_digits(m)).between(13, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": _mod97,
    "local_phone": _always,
    "national_id": lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
}


def _before(lengths: Column) -> Column:
    """Sum of the elements before each one; in chunks, so that many matches cost little more than linear time."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    sums = F.transform(chunks, lambda c: total(F.slice(lengths, c * _CHUNK + 1, _CHUNK)))
    starts = F.transform(sums, lambda x, c: total(F.slice(sums, F.lit(1), c)))
    return F.transform(lengths, lambda x, i: F.get(starts, F.floor(i / _CHUNK).cast("int"))
                       + total(F.slice(lengths, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans: array of (kind, start, end, score), by kind in the order of ``PATTERNS``,
    then by start."""
    t = F.col("t")
    step = docs.select(docs[id_col].alias("id"), as_text(docs[text_col]).alias("t"))
    step = step.select("*", *[F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()])
    some = {k: F.size(f"m_{k}") > 0 for k in PATTERNS}
    step = step.select("id", "t", *[f"m_{k}" for k in PATTERNS],
                       *[F.when(some[k], F.transform(F.split(t, p, -1), F.length)).alias(f"g_{k}") for k, p in PATTERNS.items()])
    step = step.select("*", *[F.when(some[k], F.zip_with(F.slice(f"g_{k}", F.lit(1), F.size(f"m_{k}")), F.transform(f"m_{k}", F.length), lambda g, m: g + m)).alias(f"s_{k}") for k in PATTERNS])
    step = step.select("*", *[F.when(some[k], _before(F.col(f"s_{k}"))).alias(f"b_{k}") for k in PATTERNS])

    def spans(k: str) -> Column:
        confirmed, bonus = SCORES[k]

        def span(m: Column, i: Column) -> Column:
            start = F.get(f"b_{k}", i) + F.get(f"g_{k}", i)
            end = start + F.length(m)
            left = F.greatest(start - CONTEXT, F.lit(0))
            around = F.concat_ws(" ", F.substring(t, left + 1, start - left), F.substring(t, end + 1, F.lit(CONTEXT)))
            score = F.lit(confirmed) + F.when(around.rlike(f"(?i){CONTEXT_WORDS[k]}"), F.lit(bonus)).otherwise(F.lit(0.0))
            return F.struct(F.lit(k).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"), CONFIRM[k](m).alias("ok"))

        found = F.filter(F.transform(f"m_{k}", span), lambda s: s["ok"] & (F.lit(k in BASE) | (s["score"] >= THRESHOLD)))
        return F.when(some[k], found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double,ok:boolean>>"))

    step = step.select("id", F.concat(*[spans(k) for k in PATTERNS]).alias("found"))
    return step.select(F.col("id").alias(id_col), F.transform("found", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, SHA-256 of the base spans, all spans as text, and the highest score."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; of overlapping spans the first counts."""
    marks = found.select(F.col(id_col).alias("pii_id"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("pii_marks"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = as_text(docs[text_col])

    def step(acc: Column, s: Column) -> Column:
        keeps = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), keeps.alias("out")))

    joined = docs.join(marks, docs[id_col].eqNullSafe(F.col("pii_id")), "left")
    clean = F.aggregate(F.coalesce("pii_marks", F.array().cast("array<struct<start:int,end:int,kind:string>>")), zero, step,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.withColumn(text_col, clean).drop("pii_id", "pii_marks")

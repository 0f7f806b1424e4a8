import math
import random
import re
from collections import Counter

from linkloom.llm import quality


def _counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def test_counts(spark, hard, nothing, hard_rows):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "b ", "é", "\n", " ", "\t#", "a b c d e ", "&", "\x85", "\x1c"]) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.adaptive_rules(docs).collect()}
    assert got == {i: _counts(t) for i, t in rows}
    assert sorted(tuple(r)[1:7] for r in quality.adaptive_rules(hard).collect()) == sorted(_counts(r[1]) for r in hard_rows)
    assert quality.adaptive_rules(nothing).count() == 0


def test_limits_follow_language_and_source(spark):
    """What is junk in one source is ordinary in another; junk goes, clean texts stay."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]

    def text(symbol):
        return " ".join(rng.choice(words) + symbol * (rng.random() < 0.9) for _ in range(60))

    rows = [(i, text(""), "en", "prose") for i in range(400)] + [(400 + i, text("$$"), "en", "tables") for i in range(400)]
    rows += [(1000 + i, text("%%"), "en", "prose") for i in range(10)] + [(2000 + i, text("").upper(), "en", "tables") for i in range(10)] + [(3000 + i, text(""), "xx", "new") for i in range(5)]
    got = {r.doc_id: r for r in quality.adaptive_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i].kept for i in range(10)) and not any(got[2000 + i].kept for i in range(10))
    assert all(got[i].kept for i in range(800)) and all(got[3000 + i].kept for i in range(5))
    assert got[1000].broken == "symbol_share_max" and "upper_share_max" in got[2000].broken


def _verdicts(rows):
    """The rules said again: rows (id, text, lang, source) to the broken limits of every id."""
    gamma, shares = (1 + quality.ACCURACY) / (1 - quality.ACCURACY), {}
    sound = []
    for i, text, lang, source in rows:
        words, chars, symbols, dups, repeats, lines, upper, marks = quality.measure_text(text or "")
        shares[i] = dict(zip(quality.MEASURES, (symbols / max(chars, 1), dups / max(lines, 1), repeats / max(words, 1), upper / max(chars, 1), marks / max(words, 1), (chars - symbols) / max(words, 1))))
        if words >= 10 and 100 * repeats <= 20 * words:
            sound.append((i, lang, source))

    def rounded(v):
        return 2 * gamma ** math.ceil(math.log(v) / math.log(gamma)) / (gamma + 1) if v > 0 else 0.0

    def limits(ids, m):
        low, high, factor = quality.MEASURES[m]
        v = sorted(rounded(shares[i][m]) for i in ids)
        if not v:
            return None
        at = lambda v, q: v[max(math.ceil(q * len(v)) - 1, 0)]
        tail = [x for x in v if x > 0]
        up = max(quality.FLOORS[m], factor * (at(v, high) - at(v, 0.5)), 0.5 * at(tail, quality.TAIL) if tail and at(v, high) == 0 else 0)
        return len(v), at(v, 0.5), up, max(quality.FLOORS[m], factor * (at(v, 0.5) - at(v, low))) if low else None

    def drawn(own, to):
        if own is None:
            return to
        w = own[0] / (own[0] + quality.DRAWN)
        return own[0], w * own[1] + (1 - w) * to[1], *(None if x is None else x ** w * y ** (1 - w) for x, y in zip(own[2:], to[2:]))

    out = {}
    for i, text, lang, source in rows:
        broken = set()
        for m in quality.MEASURES:
            every, ofl, own = ([j for j, a, b in sound if test(a, b)] for test in (lambda a, b: True, lambda a, b: a == lang, lambda a, b: (a, b) == (lang, source)))
            _, mid, up, down = drawn(limits(own, m), drawn(limits(ofl, m), limits(every, m)))
            broken |= {f"{m}_max"} if shares[i][m] > mid + up else set()
            broken |= {f"{m}_min"} if down is not None and shares[i][m] < mid - down else set()
        out[i] = broken
    return out


def test_verdicts_equal_the_rules_said_again(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    # groups of one, groups without a sound document, null keys
    rows += [(9000, "word " * 9, "xx", "s"), (9001, "one two three four five six seven eight nine ten", None, None), (9002, "$ " * 40, "yy", None), (9003, None, None, "s")]
    got = quality.adaptive_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3))
    want = _verdicts(rows)
    for r in got.collect():
        assert set(filter(None, r.broken.split(","))) == want[r.doc_id] and r.kept == (not r.base_failed and not want[r.doc_id])


def test_sketches_merge_and_rerun_alike(spark):
    values = spark.range(200_000).selectExpr("pmod(xxhash64(id), 1000003) / 1e6 AS value", "'m' AS measure", "CAST(id % 7 AS STRING) AS source")
    parts = quality.sketched(values, ["source"])
    assert sorted(quality.merged(parts, []).collect()) == sorted(quality.sketched(values, []).collect())
    assert sorted(parts.collect()) == sorted(quality.sketched(values.repartition(9), ["source"]).collect())


def test_held_labels(spark, sf_small):
    rules = quality.adaptive_rules(spark.read.parquet(f"{sf_small}/documents.parquet"))
    labelled = rules.join(spark.read.parquet(f"{sf_small}/labels.parquet"), "doc_id").collect()
    clean = [r for r in labelled if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)


def test_limits_are_quantiles(spark):
    """Limits are a few spreads of the group's own away, near in a uniform source and far in a varied one."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    text = lambda low, high: " ".join(word(rng.randint(low, high)) for _ in range(100))
    rows = [(i, text(4, 6), "en", "uniform") for i in range(300)] + [(1000 + i, " ".join(word(i % 10 + 2) for _ in range(100)), "en", "varied") for i in range(300)]
    rows += [(2000, text(7, 7), "en", "uniform"), (2001, text(7, 7), "en", "varied"), (2002, text(4, 6).replace(" ", "$ ", 10), "en", "uniform")]
    got = {r.doc_id: r for r in quality.adaptive_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[2000].broken == "word_length_max" and got[2001].kept and got[2002].broken == "symbol_share_max"
    assert sum(got[i].kept for i in range(300)) >= 297 and all(got[1000 + i].kept for i in range(300))

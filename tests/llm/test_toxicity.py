import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import xxhash

from linkloom.llm import toxicity


def _corpus(n=900, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["zonkhead", "plurgh", "vexwit"]
    docs, labels = [], []
    for i in range(n):
        text, toxic = [rng.choice(words) for _ in range(rng.randint(20, 80))], int(rng.random() < 0.15)
        for _ in range(max(1, len(text) // 25) * toxic):
            text[rng.randrange(len(text))] = rng.choice(bad) if rng.random() < 0.8 else f"plurghi{rng.choice(words)}"
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    return docs, labels


def _tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _corpus()
    d, y = _tables(spark, docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, y).collect()}
    assert len(got) == len(docs)
    held = [(got[i], t) for i, t in labels if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    assert sum(r.predicted for r, t in held if t) >= 0.8 * sum(t for _, t in held)
    assert sum(r.predicted for r, t in held if not t) <= 0.02 * len(held)


def test_labels_held_out_do_not_matter(spark):
    docs, labels = _corpus(300)
    d, y = _tables(spark, docs, labels)
    _, other = _tables(spark, docs, [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels])
    assert sorted(toxicity.score_toxicity(d, y).collect()) == sorted(toxicity.score_toxicity(d, other).collect())


def test_large_models_are_joined(spark):
    d, y = _tables(spark, *_corpus(300))
    a = {r.doc_id: r.score for r in toxicity.score_toxicity(d, y).collect()}
    b = {r.doc_id: r.score for r in toxicity.score_toxicity(d, y, broadcast_words=-1).collect()}
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-9
    assert sorted(r.doc_id for r in toxicity.clean(d, y).collect()) == sorted(r.doc_id for r in toxicity.clean(d, y, broadcast_words=-1).collect())


def test_rows_go_by_their_texts_whatever_the_size_of_the_model(spark):
    docs, labels = _corpus(300)
    d, y = _tables(spark, docs, labels)
    toxic = [r.doc_id for r in toxicity.score_toxicity(d, y).where("predicted = 1").collect()]
    texts = dict(docs)
    bad, good = texts[toxic[0]], next(t for i, t in docs if i not in toxic and t)
    extra = spark.createDataFrame([(None, bad), (None, good), (toxic[0], good), (None, None), (None, None)], d.schema)
    more = d.unionByName(extra)
    want = sorted(((i, t) for i, t in [*docs, (None, good), (toxic[0], good), (None, None), (None, None)] if i not in toxic or t == good), key=str)
    for bound in (toxicity.BROADCAST_WORDS, -1):
        assert sorted(((r.doc_id, r.text) for r in toxicity.clean(more, y, broadcast_words=bound).collect()), key=str) == want


def test_copies_lend_no_weight(spark):
    """A word of one toxic text that is copied often has few contexts, and stays with the shared backoff."""
    docs, labels = _corpus(300)
    docs += [(5000 + i, "an odd qwertyuiop among words that say nothing") for i in range(60)]
    labels += [(5000 + i, 1) for i in range(60)]
    d, y = _tables(spark, docs, labels)
    known = toxicity.training_labels(y, "doc_id", "toxic")
    model = toxicity.expressions(toxicity.count_texts(d.join(known, d.doc_id == known.label_id).select("y", "text")))
    assert "qwertyuiop" not in {r.w for r in model.collect()}


def test_toxicity_hard_rows(spark, hard, nothing, hard_rows):
    labels = spark.createDataFrame([(0, 1), (3, None), (4, 0), (4, 1), (None, 1), (6, 0), (7, 0), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(hard, labels).collect()
    assert len(got) == len(hard_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    kept = toxicity.clean(hard, labels)
    assert kept.columns == hard.columns and kept.count() == sum(not r.predicted for r in got)
    empty_labels = labels.limit(0)
    assert {r.predicted for r in toxicity.score_toxicity(hard, empty_labels).collect()} == {0}
    assert toxicity.score_toxicity(nothing, labels).count() == 0 and toxicity.clean(nothing, empty_labels).count() == 0


def test_beginnings_score_rare_words(spark):
    """Toxic words that are never seen twice, short and long, are scored by how they begin; so are unseen ones."""
    rng = random.Random(8)
    ordinary = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        text, toxic = [rng.choice(ordinary) for _ in range(40)], int(i % 8 == 0)
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = "zonk" + "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([1, 6])))
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    got = {r.doc_id: r for r in toxicity.score_toxicity(*_tables(spark, docs, labels)).collect()}
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert sum(p for p, t in held if t) >= 0.9 * sum(t for _, t in held) and sum(p for p, t in held if not t) <= 2


def test_texts_with_words_against_brute_force(spark):
    texts = [(0, "abcde ab"), (0, "abcde ab"), (1, "abcdx AB ab"), (1, None)]
    got = {r.w: (r.c0, r.c1) for r in toxicity.count_texts(spark.createDataFrame(texts, "y int, text string")).collect()}
    assert got == {"*": (1, 2), "ab": (1, 1), "abcde": (1, 0), "abcdx": (0, 1), "abcde*": (1, 0), "abcdx*": (0, 1), "abcd*": (1, 1)}


def _signed(text):
    return xxhash.xxh64_intdigest(text.encode(), seed=42)


def _model(train):
    """The models said again: rows (y, text) to a function that gives a word's log-likelihood ratio by all parts, and by all but one."""
    counts = defaultdict(Counter)
    for y, text in {(y, t) for y, t in train}:
        part = ((_signed(text) + (1 << 63)) % (1 << 64) - (1 << 63)) % toxicity.FOLDS
        words = set(re.findall(r"[^\W_]+", text.lower()))
        for key in words | {"*"} | {w[:k] + "*" for w in words for k in toxicity.BEGINNINGS if len(w) >= k}:
            counts[key][y, part] += 1

    def contexts(key, y, without):
        return sum(n for (z, p), n in counts[key].items() if z == y and p != without)

    def ratio(word, without=None):
        n0, n1 = contexts("*", 0, without), contexts("*", 1, without)
        if not n0 or not n1:
            return 0.0
        root = u = n1 / (n0 + n1)
        for key in [word[:k] + "*" for k in sorted(toxicity.BEGINNINGS) if len(word) >= k] + [word]:
            x, y = contexts(key, 0, without), contexts(key, 1, without)
            a = x + y
            if a >= 2:
                over = y - a * u
                excess = max(abs(over) - toxicity.DISCOUNT - toxicity.ERRORS * math.sqrt(a * u * (1 - u)), 0.0)
                if excess:
                    u = min(max((a * u + math.copysign(excess, over) + toxicity.PRIOR * u) / (a + toxicity.PRIOR), 1e-4), 1 - 1e-4)
        return math.log(u / (1 - u)) - math.log(root / (1 - root))

    return functools.lru_cache(None)(ratio)


def _scores(docs, labels):
    train = [(t, docs[i] or "") for i, t in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1]
    ratio = _model(train)

    def z(text, without=None):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return math.fsum(ratio(w, without) for w in words) / max(len(words), 1)

    bins = Counter()
    for y, text in train:
        part = ((_signed(text) + (1 << 63)) % (1 << 64) - (1 << 63)) % toxicity.FOLDS
        bins[math.floor(z(text, part) / toxicity.BIN + 0.5) if z(text, part) >= 0 else -math.floor(-z(text, part) / toxicity.BIN + 0.5), y] += 1
    a, b = toxicity.fit_curve(sorted((k * toxicity.BIN, y, n) for (k, y), n in bins.items()))
    return {i: 1 / (1 + math.exp(-(a * z(t) + b))) for i, t in docs.items()}


def test_scores_equal_the_models_said_again(spark, sf_small):
    docs, labels = _corpus(500, 7)
    for d, y in ((dict(docs), labels), ({r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()},
                                        [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()])):
        want = _scores(d, y)
        got = toxicity.score_toxicity(*_tables(spark, list(d.items()), y)).collect()
        assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)

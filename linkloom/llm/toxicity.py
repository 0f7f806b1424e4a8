"""Toxicity by class-conditional Kneser-Ney models.

From the labelled training rows a model of toxic and one of ordinary texts are counted. Both share the distribution of
words and differ by theta(w), the toxic share of a word's contexts:

    log p_1(w) / p_0(w) = logit theta(w) - logit theta(),

smoothed along the chain word, its first 8, 7, 6, 5, 4 letters (``BEGINNINGS``), all words. Contexts are distinct texts: the counts
of a beginning are the numbers of texts that continue it in any way. At each link, of a contexts and parent's share u,

    theta = (a * u + excess + PRIOR * u) / (a + PRIOR),    excess = toxic contexts - a * u, less D + ERRORS * sqrt(a * u * (1 - u)).

What lies within the discount goes to the lower order, so a rare or unseen word is scored by its beginning, and an indifferent
one adds nothing; the discount is in standard errors, not a fixed count, and so holds for tables of any size. Single contexts count
for nothing of their own: a text that is copied many times makes its words frequent, but lends them no weight.

A document's evidence is its log-likelihood under the toxic model minus that under the ordinary one, per word. A
logistic curve turns it into a score from 0 to 1. It is fitted on bins of ``BIN`` of cross-fitted evidence: each training row is scored
by the counts of the other ``FOLDS`` - 1 parts of the training texts (parted by their hash).

Counting moves the training texts once, so that copies meet, and (class, part, word or beginning) rows that each task has summed.
Smoothing moves the counts to the tasks of their first letters. Scoring broadcasts the model while it has at most ``BROADCAST_WORDS`` words; a larger one is
joined to the documents' words. The result is the same.

Defined cases: null or empty texts have no evidence and get the curve's value at 0; several labels of a document
count as the highest, null labels as none; without training rows of both classes every score is the smoothed share
of toxic training rows; repeated documents are scored row by row; a null id is never held out nor trained on; other
columns play no part.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import fresh, ship, written

# Chosen by cross-validation among training rows alone (least log-loss of cross-fitted evidence; the README has the grid).
DISCOUNT = 1.0
ERRORS = 3.0
PRIOR = 2.0
FOLDS = 3
#: Numbers of letters, the longest first.
BEGINNINGS = (8, 7, 6, 5, 4)
BIN = 0.002
THRESHOLD = 0.7
BROADCAST_WORDS = 500_000
BROADCAST_LABELS = 2_000_000
_FLUSH = 100_000
_CACHE = 100_000
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORDS.findall(text.lower()) if text else []


def beginnings_of(word: str) -> list[str]:
    """Under these keys the model has a word's beginnings, the longest first; no word holds an asterisk."""
    return [word[:k] + "*" for k in BEGINNINGS if len(word) >= k]


class Lookup(dict):
    """Word -> log-likelihood ratio, by its own entry of the model or its longest beginning's. Keeps what it has looked up, up to
    a bound."""

    def __init__(self, model: dict, nothing=0.0):  # noqa: ANN001
        super().__init__()
        self.model = model
        self.nothing = nothing

    def __missing__(self, word: str):  # noqa: ANN204
        if len(self) > _CACHE:
            self.clear()
        value = self.model.get(word)
        if value is None:
            value = next((self.model[x] for x in beginnings_of(word) if x in self.model), self.nothing)
        self[word] = value
        return value


def held_out(doc_id: Column) -> Column:
    """The rows kept back: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    own = labels.select(labels[id_col].alias("label_id"), labels[label_col].cast("int").alias("y"))
    own = own.where(F.col("label_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("label_id")))
    own = own.groupBy("label_id").agg((F.max("y") > 0).cast("int").alias("y"))
    return own


def count_texts(texts: DataFrame) -> DataFrame:
    """From rows (y, text): w (words, their beginnings, and * for all), c0, c1 (distinct ordinary and toxic texts with it), and c0_k, c1_k, those of part k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            y, part, w = zip(*seen) if seen else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(part, pa.int32()), pa.array(w, pa.string()), pa.array(seen.values(), pa.int64())], names=["y", "part", "w", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for y, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = set(words_of(text.as_py()))
                keys = words.union(["*"], *map(beginnings_of, words))
                seen.update(zip([y] * len(keys), [part] * len(keys), keys))
                if len(seen) > _FLUSH:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    once = texts.select("y", part_of(F.col("text")).alias("part"), F.xxhash64("text").alias("h"), "text").dropDuplicates(["y", "h"])
    found = once.select("y", "part", "text").mapInArrow(run, "y int, part int, w string, n long")

    def of(y: int, part: int | None = None) -> Column:
        wanted = (F.col("y") == y) if part is None else (F.col("y") == y) & (F.col("part") == part)
        return F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0)).cast("long")

    return found.groupBy("w").agg(of(0).alias("c0"), of(1).alias("c1"), *[of(y, k).alias(f"c{y}_{k}") for k in range(FOLDS) for y in (0, 1)])


def part_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def expressions(counts: DataFrame, discount: float = DISCOUNT, errors: float = ERRORS, prior: float = PRIOR) -> DataFrame:
    """w and its log-likelihood ratio (llr), for the words and beginnings that differ from the next shorter beginning; with counts of parts, llr_k is
    the ratio by the other parts. ``counts`` has distinct contexts c0 and c1 of any kind."""
    parts = sum(c.startswith("c0_") for c in counts.columns)
    names = [f"c{y}{p}" for p in ("", *[f"_{k}" for k in range(parts)]) for y in (0, 1)]
    every = counts.where("w = '*'").select(*names).head() or counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).head()

    def without(row: list[int]) -> list[tuple[int, int]]:
        """Ordinary and toxic contexts: all, and all but those of each part."""
        return [(row[0], row[1])] + [(row[0] - row[2 * k], row[1] - row[2 * k + 1]) for k in range(1, parts + 1)]

    roots = [y / (x + y) if x and y else None for x, y in without(list(every))]
    least = min(BEGINNINGS)
    out = ["llr", *[f"llr_{k}" for k in range(parts)]]

    def logit(p: float) -> float:
        return math.log(p / (1 - p))

    def smoothed(x: int, y: int, u: float) -> float:
        a = x + y
        if a < 2:
            return u
        more = y - a * u
        more = math.copysign(max(abs(more) - discount - errors * math.sqrt(a * u * (1 - u)), 0.0), more)
        return min(max(((a + prior) * u + more) / (a + prior), 1e-4), 1 - 1e-4) if more else u

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by first letters, shorter beginnings before longer ones and words."""
        start, known = None, {}
        for batch in batches:
            rows = []
            for group, w, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if group != start:
                    start, known = group, {}
                keys = beginnings_of(w.rstrip("*"))
                above = next((known[x] for x in keys if x != w and x in known), roots)
                own = [u if u is None else smoothed(x, y, u) for (x, y), u in zip(without(row), above)]
                if own != above:
                    if w.endswith("*"):
                        known[w] = own
                    rows.append((w, *[0.0 if u is None else logit(u) - logit(r) for u, r in zip(own, roots)]))
            columns = list(zip(*rows)) or [()] * (1 + len(out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.float64()) for c in columns[1:]]], names=["w", *out])

    schema = "w string, " + ", ".join(f"{x} double" for x in out)
    if roots[0] is None:
        return counts.where(F.lit(False)).select("w", *[F.lit(0.0).alias(x) for x in out])
    grouped = counts.where("w <> '*'").select(F.substring("w", 1, least).alias("start"), "w", *names).repartition("start")
    return grouped.sortWithinPartitions("start", ~F.col("w").endswith("*"), F.length("w")).mapInArrow(run, schema)


def evidence(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """id and z, the log-likelihood ratio per word, one row per document."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    id_field = own.schema["id"]
    if model.count() <= broadcast_words:
        table = spark.sparkContext.broadcast({r.w: r.llr for r in model.collect()})

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            llr = Lookup(table.value)
            for batch in batches:
                z = []
                for text in batch.column(1):
                    words = words_of(text.as_py())
                    z.append(math.fsum(map(llr.__getitem__, words)) / max(len(words), 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.float64())], names=["id", "z"])

        return own.mapInArrow(score, T.StructType([id_field, T.StructField("z", T.DoubleType())]))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                seen = Counter(words) or {"": 0}
                one = batch.column(0).slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.take(pa.array([0] * len(seen))), batch.column(2).slice(i, 1).take(pa.array([0] * len(seen))), pa.array(list(seen), pa.string()),
                                                  pa.array(list(seen.values()), pa.int64()), pa.array([len(words)] * len(seen), pa.int64())], names=["id", "row", "w", "k", "n"])

    rows = own.withColumn("row", F.monotonically_increasing_id())
    schema = T.StructType([id_field, T.StructField("row", T.LongType()), T.StructField("w", T.StringType()), T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    chain = F.array_compact(F.array(F.col("w"), *[F.when(F.length("w") >= k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in BEGINNINGS]))
    keys = rows.mapInArrow(explode, schema).select("id", "row", "k", "n", "w", F.posexplode(chain).alias("link", "key"))
    seen = keys.join(model.select(F.col("w").alias("key"), "llr"), "key", "left").groupBy("row", "id", "w", "k", "n")
    seen = seen.agg(F.min_by("llr", F.when(F.col("llr").isNotNull(), F.col("link"))).alias("llr"))
    return seen.groupBy("row", "id").agg((F.sum(F.col("k") * F.coalesce("llr", F.lit(0.0))) / F.greatest(F.max("n"), F.lit(1))).alias("z")).select("id", "z")


def crossed(texts: DataFrame, model: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """z and y of the training rows (y, text), each by the ratios of the other parts."""
    rows = texts.select("y", "text", part_of(F.col("text")).alias("part"))
    if model.count() > broadcast_words:
        found = [evidence(rows.where(F.col("part") == k), model.select("w", F.col(f"llr_{k}").alias("llr")), "y", "text", broadcast_words) for k in range(FOLDS)]
        return functools.reduce(DataFrame.unionByName, found).select("z", F.col("id").alias("y"))
    table = texts.sparkSession.sparkContext.broadcast({r[0]: tuple(r[1:]) for r in model.select("w", *[f"llr_{k}" for k in range(FOLDS)]).toLocalIterator()})
    nothing = (0.0,) * FOLDS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        llr = Lookup(table.value, nothing)
        for batch in batches:
            z = []
            for text, part in zip(batch.column(1), batch.column(2).to_pylist()):
                words = words_of(text.as_py())
                z.append(math.fsum(llr[w][part] for w in words) / max(len(words), 1))
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column(0)], names=["z", "y"])

    return rows.mapInArrow(score, "z double, y int")


def fit_curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of the logistic curve by Newton's method on (z, label, count) bins, with a weak pull of the
    slope towards 0. Of one class only, or none: slope 0 and the smoothed share of toxic rows."""
    n1 = sum(k for _, y, k in bins if y == 1)
    n = sum(k for *_, k in bins)
    a, b = 0.0, math.log((n1 + 0.5) / (n - n1 + 0.5))
    if not n1 or n1 == n:
        return a, b
    pull = 1e-3

    def loss(a: float, b: float) -> float:
        return sum(k * (math.log1p(math.exp(-abs(x))) + max(x, 0) - y * x) for z, y, k in bins for x in (a * z + b,)) + pull * a * a / 2

    now = loss(a, b)
    for _ in range(100):
        ga, gb, haa, hab, hbb = pull * a, 0.0, pull, 0.0, 1e-9
        for z, y, k in bins:
            p = 1 / (1 + math.exp(-max(min(a * z + b, 500), -500)))
            w = k * p * (1 - p)
            ga, gb = ga + k * (p - y) * z, gb + k * (p - y)
            haa, hab, hbb = haa + w * z * z, hab + w * z, hbb + w
        det = haa * hbb - hab * hab
        da, db, step = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0
        while step > 1e-6 and loss(a - step * da, b - step * db) > now:
            step /= 2
        a, b, before, now = a - step * da, b - step * db, now, loss(a - step * da, b - step * db)
        if before - now < 1e-9 * max(1, now):
            break
    return max(a, 0.0), b


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels of the training rows, the training rows (id, y, text), the model."""
    known = written(training_labels(labels, label_id_col, label_col), "toxic-labels")
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    texts = texts.join(known, texts["id"] == known["label_id"]).select("id", "y", "text")
    counts = written(count_texts(texts), "toxic-counts")
    return known, texts, written(expressions(counts), "toxic-model")


def _curve(binned: DataFrame) -> tuple[float, float]:
    """From rows (z, y). As many bins come to the driver as fit between the least and the largest evidence, not as many as rows."""
    bins = binned.groupBy(F.round(F.col("z") / BIN).cast("long").alias("bin"), "y").count()
    return fit_curve([(r["bin"] * BIN, r["y"], r["count"]) for r in bins.orderBy("bin", "y").collect()])


def _score(z: Column, curve: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(-(F.lit(curve[0]) * z + F.lit(curve[1]))))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
                   label_col: str = "toxic", threshold: float = THRESHOLD, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    ship(docs.sparkSession)
    _, texts, model = _fitted(docs, labels, id_col, text_col, label_id_col, label_col)
    z = written(evidence(docs, model, id_col, text_col, broadcast_words), "toxic-evidence")
    score = _score(F.col("z"), _curve(crossed(texts, model, broadcast_words)))
    return z.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
          label_col: str = "toxic", threshold: float = THRESHOLD, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; of any id, or none, each row goes by its own text."""
    spark = docs.sparkSession
    ship(spark)
    _, texts, model = _fitted(docs, labels, id_col, text_col, label_id_col, label_col)
    curve = _curve(crossed(texts, model, broadcast_words))
    if model.count() > broadcast_words:
        # the verdict follows from the text alone: rows go by a 128-bit hash of it
        text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
        a, b = fresh("a"), fresh("b")
        hashes = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
        found = evidence(docs.select(hashes.alias("id"), text.alias("text")), model, "id", "text", broadcast_words)
        gone = found.where(_score(F.col("z"), curve) >= threshold).select(F.col("id.a").alias(a), F.col("id.b").alias(b)).distinct()
        gone = written(gone, "toxic-texts")
        return docs.join(gone, (F.xxhash64(text) == gone[a]) & (F.xxhash64(F.lit(1), text) == gone[b]), "left_anti")
    table = spark.sparkContext.broadcast({r.w: r.llr for r in model.collect()})

    @F.pandas_udf("double")
    def z(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        llr = Lookup(table.value)
        for batch in texts:
            yield pd.Series([math.fsum(map(llr.__getitem__, w)) / max(len(w), 1) for w in map(words_of, batch)], dtype="float64")

    return docs.where(_score(z(docs[text_col].cast("string")), curve) < threshold)

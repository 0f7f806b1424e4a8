"""Quality rules with adaptive thresholds.

Each document is measured once (counts over its whole text). Per language and source, mergeable quantile sketches summarise each measure: the
documents are counted by logarithmic buckets of the measure, zero in a bucket of its own, so that any quantile is known to ``ACCURACY`` of its
value. Such a sketch is a table of counts: it merges by addition (sources into languages, those into the corpus), and a rerun gives the same one.
A measure's limits are taken from the quantiles of its own group,

    median ± factor * (outer quantile - median),

so that a source that is noisier as a whole gets wider limits, and junk stands out against its own kind. Measures that most documents have at 0 take a
further quantile and a smaller factor; where even the outer quantile is 0, half of the ``TAIL`` quantile of what is not 0 is the limit.
``FLOORS`` only stand in for a spread of (nearly) zero, where the first symbol or rounding would break a limit. Words' lengths are without
symbols, which have a measure of their own.

A small group's limits are drawn towards its language's, and those towards the corpus's, by the weight n / (n + ``DRAWN``): medians on the
line between them, distances on the geometric one. The limits join the measured rows; a row that breaks a limit goes.

Sketches are partial aggregates: a source with a third of all rows is summarised where its rows lie. Quantiles are read off in order of the buckets, of
which a measure of a group has some thousands at most; limits have a row per (language, source).

Defined cases: a null text has no words and fails; null languages and sources are groups of their own; rows count
one by one, repeated or not; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import ship, written

FENCE = 4.0
#: measure -> (lower quantile or None, upper quantile, factor on their distances from the median)
MEASURES = {
    "symbol_share": (None, 0.9, FENCE),
    "dup_line_share": (None, 0.98, 2.0),
    "repeat_share": (None, 0.98, 2.0),
    "upper_share": (None, 0.9, FENCE),
    "mark_share": (None, 0.9, FENCE),
    "word_length": (0.1, 0.9, FENCE),
}
#: The least distance of a limit from the median: 5 in 1,000, of words' length a twentieth of a letter.
FLOORS = dict.fromkeys(MEASURES, 0.005) | {"word_length": 0.05}
#: Documents at which a group's own limits and its language's weigh alike.
DRAWN = 100
#: Of what is not zero, the quantile that bounds the tail from below.
TAIL = 0.05
#: Relative error of a sketched value.
ACCURACY = 0.001
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
_ZERO = -1_000_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?"
_WHITE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(0x41, 0x5B))
WINDOW = 5


def count_repeats(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(set(windows)) == n:
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def measure_text(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, _WHITE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    marks = len(raw) - len(raw.translate(None, _MARKS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else [raw] * bool(words)
    return len(words), chars, symbols, len(lines) - len(set(lines)), count_repeats(words), len(lines), upper, marks


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source and the counts of ``measure_text``, one row per document."""
    ship(docs.sparkSession)
    own = docs.select(docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([own.schema["id"], own.schema["lang"], own.schema["source"], *[T.StructField(c, T.LongType()) for c in _COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [measure_text(t.as_py() or "") for t in batch.column(3)]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=["id", "lang", "source", *_COUNTS])

    return own.mapInArrow(run, schema)


def _shares() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words, "upper_share": F.col("n_upper") / chars,
        "mark_share": F.col("n_marks") / words, "word_length": (F.col("word_chars") - F.col("n_symbols")) / words,
    }


def sketched(values: DataFrame, keys: list[str]) -> DataFrame:
    """From rows (keys, measure, value) the sketches: keys, measure, bucket, n."""
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / F.lit(math.log(_GAMMA))).cast("int")).otherwise(F.lit(_ZERO))
    return values.groupBy(*keys, "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def _by_measure(values: dict[str, float | None]) -> Column:
    out = F.lit(None).cast("double")
    for m, v in values.items():
        if v is not None:
            out = F.when(F.col("measure") == m, F.lit(float(v))).otherwise(out)
    return out


def quantile_limits(sketches: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Per group and measure: the number of documents, the median and the distances of the upper and lower limit from it."""
    whole = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    zeros = F.sum(F.when(F.col("bucket") == _ZERO, F.col("n")).otherwise(0)).over(whole)
    ranked = sketches.select(*keys, "measure", "bucket", F.sum("n").over(whole).alias("total"), upto.alias("upto"), zeros.alias("zeros"))

    def at(q: Column) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket")))

    tail = F.min(F.when((F.col("bucket") > _ZERO) & (F.col("upto") - F.col("zeros") >= TAIL * (F.col("total") - F.col("zeros"))), F.col("bucket")))
    found = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("n"), at(F.lit(0.5)).alias("mid"), at(_by_measure({m: v[1] for m, v in MEASURES.items()})).alias("high"),
                                                 at(_by_measure({m: v[0] for m, v in MEASURES.items()})).alias("low"), tail.alias("tail"))
    value = lambda c: F.when(F.col(c) > _ZERO, F.pow(F.lit(_GAMMA), F.col(c)) * (2 / (_GAMMA + 1))).otherwise(0.0)
    factor, floor = _by_measure({m: v[2] for m, v in MEASURES.items()}), _by_measure(FLOORS)
    up = F.greatest(floor, factor * (value("high") - value("mid")), F.when(F.col("high") == _ZERO, 0.5 * value("tail")).otherwise(0.0))
    return found.select(*[F.col(k).alias(f"{prefix}_{k}") for k in keys], F.col("measure").alias(f"{prefix}_measure"), F.col("n").alias(f"{prefix}_n"),
                        value("mid").alias(f"{prefix}_mid"), up.alias(f"{prefix}_up"), F.greatest(floor, factor * (value("mid") - value("low"))).alias(f"{prefix}_down"))


def adaptive_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, the counts, base_failed, kept, and broken (names of the broken limits)."""
    rows = written(measure(docs, id_col, text_col, lang_col, source_col), "quality-measures")
    shares = _shares()
    # only documents that pass the base rules shape the limits: junk must not widen its own fence
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    sound = rows.where(~failed).select("lang", "source", *[c.alias(m) for m, c in shares.items()])
    values = sound.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])).alias("v"))
    by_source = written(sketched(values.select("lang", "source", "v.measure", "v.value"), ["lang", "source"]), "quality-sketches")
    s = quantile_limits(by_source, ["lang", "source"], "s")
    g = quantile_limits(merged(by_source, ["lang"]), ["lang"], "l")
    overall = quantile_limits(merged(by_source, []), [], "a")

    keys = rows.select("lang", "source").distinct().withColumn("measure", F.explode(F.array(*[F.lit(m) for m in MEASURES])))
    met = (keys.join(s, keys["lang"].eqNullSafe(s["s_lang"]) & keys["source"].eqNullSafe(s["s_source"]) & (keys["measure"] == s["s_measure"]), "left")
           .join(g, keys["lang"].eqNullSafe(g["l_lang"]) & (keys["measure"] == g["l_measure"]), "left").join(overall, keys["measure"] == overall["a_measure"], "left"))

    def drawn(own: str, to: dict[str, Column]) -> dict[str, Column]:
        n = F.coalesce(F.col(f"{own}_n"), F.lit(0))
        w = n / (n + DRAWN)
        mid = w * F.coalesce(F.col(f"{own}_mid"), to["mid"]) + (1 - w) * to["mid"]
        return {"mid": mid, **{x: F.exp(w * F.log(F.coalesce(F.col(f"{own}_{x}"), to[x])) + (1 - w) * F.log(to[x])) for x in ("up", "down")}}

    limit = drawn("s", drawn("l", {x: F.col(f"a_{x}") for x in ("mid", "up", "down")}))
    limits = met.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct((limit["mid"] + limit["up"]).alias("max"), (limit["mid"] - limit["down"]).alias("min"))))).alias("limits"))
    limits = limits.select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), "limits")
    names = [f"{m}_max" for m in MEASURES] + [f"{m}_min" for m, v in MEASURES.items() if v[0]]

    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["k_lang"]) & rows["source"].eqNullSafe(limits["k_source"]), "left")
    bound = lambda x: F.col("limits")[x[:-4]][x[-3:]]
    breaks = [F.when(shares[x[:-4]] > bound(x) if x.endswith("_max") else shares[x[:-4]] < bound(x), F.lit(x)) for x in names]
    broken = F.array_compact(F.array(*breaks))
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & (F.size(broken) == 0)).alias("kept"), F.array_join(broken, ",").alias("broken"))

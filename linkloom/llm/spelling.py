"""Groups of spelling variants by permuterm rotations.

Words are counted over all texts. A word w and a terminator, written in a circle, give len(w) + 1 rotations. Let a rotation be y $ x for
the word xy. Words that differ from each other in one replaced code point, x c y and x d y, have the rotations y $ x c and y $ x d; a
word that lacks the code point has y $ x itself. So every rotation enters the sorted list twice: whole, where it opens a range, and without
its last code point, the edited one, where it falls into the range that the rest opens. A range is a group of equal prefixes: at most
one whole rotation and one word for every letter of the alphabet, however large the vocabulary. Ranges are scanned in order, and of each the
neighbours of its members are emitted in sum (how many, and the most frequent), never pair by pair.

Every pair of near words meets in exactly one range: that of its edited position, where for an insertion into a run of the same letter the
first position of the run counts (``opens``).

A word's form is its most frequent near word if that is ``RATIO`` times as frequent; forms are followed to the last by doubling pointers,
as many rounds as the binary logarithm of the longest chain (frequencies grow by the ratio at each link).

What is moved: counts of the words that each task has summed; 2 len(w) + 1 rows for each word of the vocabulary, range-partitioned; a row
per word and range with neighbours. Nothing is collected or broadcast by hand.

Defined cases: null and empty texts have no words; a null id is written as nothing in the sum that chooses the words to distort; repeated rows
are counted as often as they come; ties in frequency go to the word smallest in code-point order; other columns play no part; an empty table
gives an empty result. Words may hold any code point but U+0000, the terminator.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import ship, small_batches, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: Of (document, run) sums divisible by this, one letter is left out; 0: of none.
DISTORTED = 199
TERMINATOR = "\x00"
LETTERS = r"A-Za-zÀ-ÿ"
_FLUSH = 200_000


def distorted(doc_id: str, run: bytes, modulus: int) -> str:
    """A lower-cased run as the document has it: without one code point if its checksum says so."""
    word = run.decode()
    if modulus:
        h = zlib.crc32(run, zlib.crc32(f"{doc_id}:".encode()))
        if h % modulus == 0:
            at = h % len(word)
            return word[:at] + word[at + 1:]
    return word


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                modulus: int = DISTORTED) -> DataFrame:
    """word and n: runs of letters of all texts, ASCII capitals lowered, of at least so many code points and occurrences."""
    ship(docs.sparkSession)
    # a run that is too short cannot grow
    pattern = f"[{LETTERS}]{{{least_length},}}"

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts = re.compile(pattern), Counter()
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                if not (text := text.as_py()):
                    continue
                name = name.as_py() or ""
                for found, k in Counter(runs.findall(text)).items():
                    word = distorted(name, found.encode().lower(), modulus)
                    if len(word) >= least_length:
                        counts[word] += k
                if len(counts) > _FLUSH:
                    yield out(counts)
                    counts.clear()
        yield out(counts)

    texts = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        found = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
        return written(found, "spelling-words")


def rotations(words: DataFrame) -> DataFrame:
    """The entries of the sorted list: key (a rotation, or one without its last code point), edited (that code point, empty for a whole
    rotation), opens (whether the code point before the edited one is another), n."""
    marked = F.concat("word", F.lit(TERMINATOR))
    turned = words.select("n", marked.alias("m"), F.length("word").alias("size"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    text = F.concat(F.expr("substring(m, i + 1)"), F.expr("substring(m, 1, i)"))
    turned = turned.select("n", "i", "size", text.alias("rotation"))
    last, before = F.expr("substring(rotation, size + 1, 1)"), F.expr("substring(rotation, size, 1)")
    whole = turned.select(F.col("rotation").alias("key"), F.lit("").alias("edited"), F.lit(True).alias("opens"), "n")
    return whole.unionByName(turned.where("i > 0").select(F.expr("substring(rotation, 1, size)").alias("key"), last.alias("edited"), (last != before).alias("opens"), "n"))


def _range_neighbours(key: str, members: list[tuple[str, bool, int]]) -> Iterator[tuple[str, int, int, str]]:
    """Of one range: word, how many near words it has here, the most frequent of them with its n."""
    behind, _, ahead = key.partition(TERMINATOR)
    whole, skipped, opening = None, [], []
    for edited, opens, n in members:
        row = (-n, ahead + edited + behind, opens)
        if not edited:
            whole = row
        else:
            skipped.append(row)
            if opens:
                opening.append(row)
    skipped.sort()
    for own in skipped:
        best = [x for x in skipped[:2] if x is not own][:1]
        count = len(skipped) - 1
        if whole and own[2]:
            best, count = [min([*best, whole])], count + 1
        if count:
            yield own[1], count, -best[0][0], best[0][1]
    if whole and opening:
        best = min(opening)
        yield whole[1], len(opening), -best[0], best[1]


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near: for every word with a near word how many it has, and the most frequent (ties: the smallest)."""
    ship(words.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            found = []
            for at, *entry in zip(*(c.to_pylist() for c in batch.columns)):
                if at != key:
                    if len(members) > 1:
                        found.extend(_range_neighbours(key, members))
                    key, members = at, []
                members.append(entry)
            yield out(found)
        if len(members) > 1:
            yield out(list(_range_neighbours(key, members)))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "k", "n", "near"])

    listed = rotations(words).repartitionByRange("key").sortWithinPartitions("key")
    found = listed.mapInArrow(scan, "word string, k long, n long, near string")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("near")))
    summed = found.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("best"))
    return summed.select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def followed(forms: DataFrame) -> DataFrame:
    """From rows (word, form), which have no circle, to (word, root): the last word that forms lead to."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("stop"), F.col("root").alias("next"))
        step = at.join(ahead, at["root"] == ahead["stop"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = written(step, "spelling-roots")
        at = step.select("word", "root")
        if not step.where("moved").head(1):
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                      ratio: int = RATIO, modulus: int = DISTORTED) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    return variants_of(count_words(docs, id_col, text_col, least_length, least_count, modulus), ratio)


def variants_of(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """As ``spelling_variants``, from distinct words and their frequencies (word, n)."""
    near = near_words(words)
    joined = words.join(near, "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    named = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near")).alias("form"),
                                  F.when(has, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = followed(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

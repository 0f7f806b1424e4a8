"""Alignment of two tokenizers by merge-path partitioning.

A is a byte-level BPE of a space and the text, B a sentence-piece BPE with byte fallback of the text (it adds the space itself). Both
give a sorted list of byte offsets where tokens end. Offsets where both end cut the tokens into groups, the smallest stretches that
the two tokenizers spell alike as a whole.

The lists of a slice of documents, laid end to end, are merged once. The merge is a path of len(A) + len(B) steps through a grid;
every ``PIECE``-th diagonal of the grid is searched by bisection for the cell in which the path crosses it (all diagonals at a time),
and the stretches between, of equal work and independent of each other, advance together, one numpy lane each. A step of a piece stands
on a pair of tokens: an overlap, unless the one ends where the other begins. Where both end together it is a link as well, which closes a
group; pieces are stitched by letting a group begin at the last link of any earlier piece.

Encoding goes by words: neither tokenizer has a token across a space behind a non-space (checked when the vocabularies are loaded;
a sentence-piece model that has one is given whole texts), so a worker encodes a distinct word once and keeps it, up to ``CACHE_WORDS``.

Documents are encoded and merged in one pass without shuffle into a table; of it the counts of linked id pairs are summed, map-side
first. They are broadcast up to ``BROADCAST_PAIRS`` rows, above that joined; the result is the same.

Defined cases: null and empty texts, and texts that a tokenizer does not spell byte by byte (the character U+2581), have no tokens,
zeros and an empty digest; repeated rows and ids are kept row by row and each counts towards the pairs; a null id stays null; a long text
is one document of many pieces; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.bpe import byte_symbols
from linkloom.llm.common import ship, small_batches, written

#: Merge steps of a piece.
PIECE = 128
#: Characters of text that are laid end to end for one merge (a longer document is merged alone).
SLICE = 400_000
CACHE_WORDS = 400_000
#: New words that are encoded as one text.
TOGETHER = 64
BROADCAST_PAIRS = 4_000_000
#: The characters after which a word may be cut off: a space between a non-space and more text.
_CUT = re.compile(r"(?<=\S) (?=\s*\S)")
_DIGITS = 12


class Vocabularies:
    """Both tokenizers, the number of bytes of every token, and the words encoded so far."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        back = {ord(s): b for b, s in enumerate(byte_symbols())}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(back[ord(c)] for c in names[i]) if all(ord(c) in back for c in names[i]) else names[i].encode() for i in range(self.n_a)]
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cut = not any(re.search("[^▁]▁", p) for p in pieces)
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sound = np.zeros(0, bool)
        self.pools = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def learn(self, words: list[str]) -> None:
        """Encode words, each with the space before it. Those that neither begin nor end with white space are encoded ``TOGETHER`` at a
        time, as one text of words; the bytes of their tokens tell them apart again."""
        plain = [w for w in words if not (w[0].isspace() or w[-1].isspace())] if self.cut else []
        rest = [w for w in words if w[0].isspace() or w[-1].isspace()] if self.cut else words
        units = [" ".join(plain[k:k + TOGETHER]) for k in range(0, len(plain), TOGETHER)] + rest
        words = plain + rest
        if words and not self._learned(words, units):
            for word in words:
                self._learned([word], [word]) or self._added([word], [np.zeros(0, np.int64)] * 2, [np.zeros(1, np.int64)] * 2, False)

    def _learned(self, words: list[str], units: list[str]) -> bool:
        """Encode the words, which the units are made of, if both tokenizers spell all of them."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        raw = "".join([" " + u for u in units]).encode()
        marks = np.cumsum([len(w.encode()) + 1 for w in words])
        flat, sizes = [], []
        for found, spelled, length in ((a, self.a_bytes, self.a_length), (b, self.b_bytes, self.b_length)):
            ids = list(chain.from_iterable(found))
            if b"".join(map(spelled.__getitem__, ids)) != raw:
                return False
            flat.append(np.array(ids, np.int64))
            sizes.append(np.diff(np.searchsorted(np.cumsum(length[flat[-1]]), marks, "right"), prepend=0))
        self._added(words, flat, sizes, True)
        return True

    def _added(self, words: list[str], flat: list[np.ndarray], sizes: list[np.ndarray], sound: bool) -> None:
        for word in words:
            self.known[word] = len(self.known)
        self.sound = np.concatenate([self.sound, np.full(len(words), sound)])
        for side in (0, 1):
            self.starts[side] = np.concatenate([self.starts[side], np.cumsum(sizes[side]) + self.starts[side][-1]])
            self.pools[side] = np.concatenate([self.pools[side], flat[side]])

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of all texts laid end to end, and for each the number of ids of every text."""
        if len(self.known) > CACHE_WORDS or max(map(len, self.pools)) > 8 * CACHE_WORDS:
            self.forget()
        words = [(_CUT.split(t) if self.cut else [t]) if t else [] for t in texts]
        flat = list(chain.from_iterable(words))
        self.learn([w for w in dict.fromkeys(flat) if w not in self.known])
        code = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        of = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        unsound = np.zeros(len(texts), bool)
        unsound[of[~self.sound[code]]] = True
        kept = ~unsound[of]
        code, of = code[kept], of[kept]
        ids, counts = [], []
        for side in (0, 1):
            first, size = self.starts[side][code], np.diff(self.starts[side])[code]
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            ids.append(self.pools[side][at])
            counts.append(np.bincount(of, weights=size, minlength=len(texts)).astype(np.int64))
        return ids, counts


@functools.lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


def crossings(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of the sorted lists ``a`` and ``b`` (equal values: ``a`` first) crosses every ``piece``-th diagonal: the
    numbers of values taken of each. All diagonals are bisected at once."""
    diagonal = np.arange(0, len(a) + len(b), piece, dtype=np.int64)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (low < high).any():
        open_ = low < high
        middle = (low + high) >> 1
        # the middle cell lies before the path if its value of a goes before the last value of b on this diagonal
        before = a[np.minimum(middle, len(a) - 1)] <= b[np.clip(diagonal - middle - 1, 0, len(b) - 1)]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low, diagonal - low


def merge_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge of two strictly ascending lists of ends of the same length of text, in the order of the path: numbers of the tokens i of
    A and j of B, and whether they end together. Rows are the pairs of tokens that overlap, each once."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    i, j = crossings(a, b, piece)
    steps = min(piece, len(a) + len(b))
    far = max(a[-1], b[-1]) + 1
    a_next, b_next = np.append(a, far), np.append(b, far)
    at, together, overlap = (np.empty((len(i), steps), d) for d in (np.int64, bool, bool))
    start = i + j
    before = np.where(i > 0, a_next[i - 1], -1)
    for step in range(steps):
        x, y = a_next[i], b_next[j]
        at[:, step], together[:, step] = i, x == y
        overlap[:, step] = before != y  # the token of A ended here already: only the end of B is left to take
        take = x <= y
        before = np.where(take, x, before)
        i = np.minimum(i + take, len(a))
        j = np.minimum(j + ~take, len(b))
    number = (start[:, None] + np.arange(steps)).ravel()
    inside = (number < len(a) + len(b)) & overlap.ravel()
    i = at.ravel()[inside]
    return i, number[inside] - i, together.ravel()[inside]


def _spelled(ids: np.ndarray, separator: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Decimal ids, each with its separator, and where each ends."""
    width = np.ones(len(ids), np.int64)
    for k in range(1, _DIGITS):
        width += ids >= 10 ** k
    ends = np.cumsum(width + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = separator
    rest, left = ids.copy(), width.copy()
    place = ends - 2
    while len(rest):
        out[place] = 48 + rest % 10
        more = left > 1
        rest, place, left = rest[more] // 10, place[more] - 1, left[more] - 1
    return out.tobytes(), ends


def align(ids: list[np.ndarray], counts: list[np.ndarray], lengths: tuple[np.ndarray, np.ndarray]) -> dict:
    """Documents laid end to end: per document the numbers of groups and links, its digest, its links (ids of A and of B) and where its
    groups end, counted in tokens of A and of B."""
    a, b = ids
    i, j, together = merge_ends(np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b]))
    i, j = i[together], j[together]  # the links; a group begins behind the link before, whichever piece that lies in
    n_docs = len(counts[0])
    doc_a, doc_b = (np.concatenate([[0], np.cumsum(c)]) for c in counts)
    first = np.searchsorted(i, doc_a)  # a document's end is a link
    # tokens in the order of the digest: of each group those of A, then those of B
    a_sizes, b_sizes = np.diff(np.concatenate([[-1], i])), np.diff(np.concatenate([[-1], j]))
    a_place = np.arange(len(a)) + np.repeat(j - b_sizes + 1, a_sizes)
    b_place = np.arange(len(b)) + np.repeat(i + 1, b_sizes)
    order, separator = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    order[a_place], order[b_place] = a, b
    separator[a_place[i]], separator[b_place[j]] = ord("|"), ord(";")
    text, ends = _spelled(order, separator)
    bounds = np.concatenate([[0], ends])[doc_a + doc_b]
    digests = [hashlib.sha256(text[bounds[k]:bounds[k + 1] - 1]).hexdigest() if bounds[k + 1] > bounds[k] else "" for k in range(n_docs)]
    groups = np.diff(first)
    return {"groups": groups, "links": groups, "digest": digests, "first": first, "link_a": a[i], "link_b": b[j],
            "end_a": i + 1 - np.repeat(doc_a[:-1], groups), "end_b": j + 1 - np.repeat(doc_b[:-1], groups)}


def _slices(batch: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    start, held, size = 0, [], 0
    for k, value in enumerate(batch):
        text = value.as_py()
        if held and size + len(text or "") > SLICE:
            yield start, held
            start, held, size = k, [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield start, held


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups_sha256 and link_codes, the linked ids as id of A * size of B's
    vocabulary + id of B, in order; with ``with_groups`` also a_ids, b_ids and, of every group, where it ends in them (a_ends, b_ends)."""
    ship(docs.sparkSession)
    sizes = load(a_path, b_path)
    n_b, wide = sizes.n_b, sizes.n_a * sizes.n_b >= 1 << 31
    code = (T.LongType(), pa.int64()) if wide else (T.IntegerType(), pa.int32())
    longs = [T.StructField(c, T.LongType(), False) for c in ("n_a", "n_b", "n_groups", "n_links")]
    extra = ["a_ids", "b_ids", "a_ends", "b_ends"] if with_groups else []
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *longs, T.StructField("groups_sha256", T.StringType(), False),
                           T.StructField("link_codes", T.ArrayType(code[0], False), False), *[T.StructField(c, T.ArrayType(T.LongType(), False), False) for c in extra]])

    def lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(a_path, b_path)
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                ids, counts = both.encode(texts)
                found = align(ids, counts, (both.a_length, both.b_length))
                columns = [batch.column(0).slice(start, len(texts)), *[pa.array(c, pa.int64()) for c in (*counts, found["groups"], found["links"])],
                           pa.array(found["digest"], pa.string()), lists(found["first"], found["link_a"] * n_b + found["link_b"], code[1])]
                if with_groups:
                    columns += [lists([0, *accumulate(c.tolist())], x, pa.int64()) for x, c in zip(ids, counts)]
                    columns += [lists(found["first"], found[e], pa.int64()) for e in ("end_a", "end_b")]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """From ``alignments``: code, a_id, b_id, n links hold the pair, and whether no other id of A is linked to b_id more often."""
    counts = aligned.select(F.explode("link_codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.select("code", F.expr(f"CAST(code DIV {n_b} AS INT)").alias("a_id"), F.pmod("code", F.lit(n_b)).cast("int").alias("b_id"), "n"), "align-pairs")
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("code", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    n_b = load(a_path, b_path).n_b
    with small_batches(spark):
        aligned = written(alignments(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "align-docs")
    pairs = written(pair_counts(aligned, n_b).select("code", "n", "best"), "align-counts")
    plain = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if pairs.count() > broadcast_pairs:
        links = aligned.select("row", F.explode("link_codes").alias("code")).groupBy("row", "code").agg(F.count(F.lit(1)).alias("k"))
        sums = links.join(pairs, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        scored = aligned.join(sums, "row", "left").select(*plain, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
    else:
        table = pairs.orderBy("code").toArrow()
        shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "n", "best")))
        kept = aligned.select(*plain, "link_codes")
        schema = T.StructType([*kept.select(plain).schema, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, counts, best = shared.value
            for batch in batches:
                links = batch.column(len(plain)).combine_chunks() if isinstance(batch.column(len(plain)), pa.ChunkedArray) else batch.column(len(plain))
                at = np.searchsorted(codes, links.flatten().to_numpy(zero_copy_only=False))
                ends = np.cumsum(np.concatenate([[0], links.value_lengths().to_numpy(zero_copy_only=False)]).astype(np.int64))
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[ends]) for x in (best, counts)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(plain)], *[pa.array(x, pa.int64()) for x in sums]], names=schema.names)

        with small_batches(spark, 2000):
            scored = written(kept.mapInArrow(score, schema), "align-scored")
    return scored.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.col("n_best").cast("long").alias("n_best"),
                         F.col("count_sum").cast("long").alias("count_sum"), "groups_sha256")

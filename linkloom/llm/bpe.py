"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the vocabulary's pre-token pattern. Each piece is a doubly linked list of byte
symbols; a priority queue of (merge rank, position) pops the best merge, skips entries that earlier merges made
stale, joins the two symbols and queues the new neighbours. Decoding concatenates vocabulary strings.

The work is row-local (no shuffle). A worker keeps a bounded cache of pieces it has already encoded; when the
cache is full it is emptied, which costs time but never changes a result.

Defined cases: a null text is the empty text (no ids); an id outside the vocabulary decodes to nothing; bytes that
are no valid UTF-8 decode to U+FFFD; repeated rows are encoded each for itself; other columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import ship

CACHE_PIECES = 250_000

# Fixed value: the published pre-token pattern of this vocabulary family.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, the rest
    take the code points from 256 on, in byte order."""
    printable = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary file (JSON with ``model.vocab``, ``model.merges`` and ``added_tokens``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        #: (left id, right id) -> (rank, merged id)
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        symbols = byte_symbols()
        self.byte_ids = [self.vocab[s] for s in symbols]
        back = {ord(s): b for b, s in enumerate(symbols)}
        self.strings = {i: bytes(back[ord(c)] for c in s) for s, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings.update({i: s.encode() for s, i in self.added.items()})
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        merges = self.merges
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two symbols has been merged meanwhile
            ids[i], ids[j] = joined, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((joined, ids[k])):
                    heapq.heappush(queue, (m[0], i, joined, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], joined))):
                heapq.heappush(queue, (m[0], h, ids[h], joined, m[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> Iterator[int]:
        """Ids of a whole text; strings of added tokens become their ids."""
        if not self.added or not any(s in text for s in self.added):
            return self._encode_plain(text)
        parts = self.specials.split(text)
        return chain.from_iterable((self.added[p],) if p in self.added else self._encode_plain(p) for p in parts if p)

    def _encode_plain(self, text: str) -> Iterator[int]:
        cache, pieces = self.cache, self.pieces.findall(text)
        if len(cache) > CACHE_PIECES:
            cache.clear()
        for piece in set(pieces).difference(cache):
            cache[piece] = tuple(self.merge(piece.encode()))
        return list(chain.from_iterable(map(cache.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        try:
            raw = b"".join(map(strings.__getitem__, ids))
        except KeyError:
            raw = b"".join(strings.get(i, b"") for i in ids)
        return raw.decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encoded(text: Column, vocabulary: str) -> Column:
    """Column of id arrays."""
    ship(SparkSession.active())

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        bpe = load(vocabulary)
        return pd.Series([list(bpe.encode(t or "")) for t in texts], dtype=object)

    return encode(text)


def decoded(ids: Column, vocabulary: str) -> Column:
    """Column of texts from a column of id arrays (null ids: empty text)."""
    ship(SparkSession.active())

    @F.pandas_udf(T.StringType())
    def decode(rows: pd.Series) -> pd.Series:
        bpe = load(vocabulary)
        return pd.Series([bpe.decode([] if r is None else list(r)) for r in rows], dtype=object)

    return decode(ids)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: id, n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text, and the
    ids themselves if asked for. Both directions run in one pass."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False),
        *([T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        digits = {i: str(i) for i in bpe.strings}
        for batch in batches:
            counts, id_sums, text_sums, held = [], [], [], []
            for text in batch.column(1):
                ids = list(bpe.encode(text.as_py() or ""))
                counts.append(len(ids))
                id_sums.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                text_sums.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    held.append(pa.array(ids, pa.int32()))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            if with_ids:
                offsets = pa.array([0, *accumulate(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(held) if held else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_col, docs[text_col].cast("string").alias(f"{text_col}_")).mapInArrow(run, schema)

"""Token ids as directly addressable codes (DAC).

Every id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id, level 1 the second chunk
of the ids that go on, and so on. A bitmap per level tells which ids go on, and a rank directory (set bits before
each 512-bit block) turns a position at one level into the position at the next. So any single id is read with one
rank per level, without decoding a block.

The files are a Parquet table in ascending document order, one row per shard of about ``SHARD_IDS`` ids, whole documents; the binary columns hold the levels, bitmaps and directories. Documents are placed by a range
partitioning on the id column, so the files of one table, in order of (part, shard), are in ascending id order.

Defined cases: a null text is empty and holds only the end id; an empty table gives an empty table of files;
repeated document ids are kept, ordered among themselves by text; null document ids come first; other columns are
not stored.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import bounded_batches, ship
from linkloom.operators.asof import asof_join

CHUNK_BITS = 8
RANK_BLOCK = 512
SHARD_IDS = 1 << 20
#: Ids are put together for so many documents at a time.
GATHER_DOCS = 256
#: Texts go to a Python worker in batches of so many bytes.
BATCH_BYTES = 8 << 20
CACHE_WORDS = 1_000_000


class Dac:
    """Encoder and random access reader of one shard."""

    def __init__(self, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray], n: int):
        self.levels, self.bitmaps, self.ranks, self.n = levels, bitmaps, ranks, n

    @classmethod
    def of(cls, ids: np.ndarray) -> "Dac":
        left, levels, bitmaps, ranks = ids.astype(np.uint32), [], [], []
        while True:
            levels.append((left & 0xFF).astype(np.uint8))
            left = left >> CHUNK_BITS
            goes_on = left > 0
            bitmap = np.packbits(goes_on, bitorder="little")
            set_bits = np.add.reduceat(goes_on.astype(np.uint32), np.arange(0, len(left), RANK_BLOCK)) if len(left) else np.zeros(0, np.uint32)
            bitmaps.append(bitmap)
            ranks.append(np.concatenate([[0], np.cumsum(set_bits)[:-1]]).astype(np.uint32) if len(left) else set_bits)
            left = left[goes_on]
            if not len(left):
                return cls(levels, bitmaps, ranks, len(ids))

    def rank(self, level: int, i: int) -> int:
        """Set bits before position i."""
        block = i // RANK_BLOCK
        first = block * RANK_BLOCK // 8
        whole = int.from_bytes(self.bitmaps[level][first : i // 8].tobytes(), "little").bit_count()
        rest = int(self.bitmaps[level][i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(self.ranks[level][block]) + whole + rest.bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, chunks in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if not self.bitmaps[level][i // 8] >> (i % 8) & 1:
                break
            i = self.rank(level, i)
        return value

    def all(self) -> np.ndarray:
        """Every id, from the last level up."""
        values = np.zeros(0, np.uint32)
        for chunks, bitmap in zip(reversed(self.levels), reversed(self.bitmaps)):
            here = chunks.astype(np.uint32)
            goes_on = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            here[goes_on] |= values << CHUNK_BITS
            values = here
        return values

    def pack(self) -> dict[str, list[bytes]]:
        return {"levels": [x.tobytes() for x in self.levels], "bitmaps": [x.tobytes() for x in self.bitmaps],
                "ranks": [x.tobytes() for x in self.ranks]}

    @classmethod
    def unpack(cls, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], n: int) -> "Dac":
        return cls([np.frombuffer(x, np.uint8) for x in levels], [np.frombuffer(x, np.uint8) for x in bitmaps],
                   [np.frombuffer(x, np.uint32) for x in ranks], n)


class Words:
    """Ids of texts, word by word. This vocabulary drops white space and never joins across it, so a text's ids are
    its words' ids in a row, and lower-casing A-Z first changes nothing. So only the distinct words of a batch
    are encoded, those of plain letters in one go: the pre-tokenizer leaves them whole, and the vocabulary marks their ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        # lower-case Latin letters that normalisation leaves as they are, and a full stop or comma behind them
        self._forget()
        self.plain = r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+[.,]?$" if suffix else "^$"

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words: one array, and where each word's ids start and how many they are. Words are encoded once and kept, up
        to ``CACHE_WORDS`` of them."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        names = words.to_pylist()
        new = [w for w in names if w not in self.known]
        if new:
            pool, starts, sizes = self._encoded(pa.array(new, words.type))
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.starts = np.concatenate([self.starts, starts + len(self.pool)])
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, pool])
        code = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return self.pool, self.starts[code], self.sizes[code]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(words, self.plain)
        mask = plain.to_numpy(zero_copy_only=False)
        whole = words.filter(plain)
        stems = pc.ascii_rtrim(whole, characters=".,").dictionary_encode()
        parts = []
        if len(stems.dictionary):
            parts = self._ids([" ".join(stems.dictionary.to_pylist())])
        ids = parts[0] if parts else np.zeros(0, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(stems.dictionary):
            raise ValueError("the vocabulary does not mark the ends of words")
        odd = self._ids(words.filter(pc.invert(plain)).to_pylist())
        tails = self._ids([".", ","])
        pool = np.concatenate([ids, *tails, *odd])
        begin = np.concatenate([[0], stops[:-1]]) if len(stops) else np.zeros(0, np.int64)
        size = np.array([len(t) for t in tails] + [len(x) for x in odd], np.int64)
        after = len(ids) + np.cumsum(size) - size
        # two stretches of the pool for each word: its stem (or the whole odd word), and its tail
        first, second = np.zeros((2, len(words)), np.int64), np.zeros((2, len(words)), np.int64)
        code = stems.indices.to_numpy()
        first[:, mask] = begin[code], (stops - begin)[code]
        first[:, ~mask] = after[2:], size[2:]
        last = [pc.ends_with(whole, t).to_numpy(zero_copy_only=False) for t in (".", ",")]
        second[:, mask] = [np.select(last, after[:2]), np.select(last, size[:2])]
        starts, sizes = np.stack([first, second], 2).reshape(2, -1)
        counts = first[1] + second[1]
        return _stretches(pool, starts, sizes), np.cumsum(counts) - counts, counts

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The words of all texts as numbers, where each text's begin, and the ids of the distinct words."""
        # a copy that starts at 0: ascii_lower misreads slices
        texts = pc.fill_null(pa.concat_arrays([texts]).cast(pa.large_string()), "")
        # strings of special tokens are lower case: a text that may hold one is left as it is
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = lists.flatten().dictionary_encode()
        return words.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), self._distinct(words.dictionary)


def _stretches(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of the pool in a row."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


@functools.lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


_FILES = ("part int, shard int, doc_ids array<{id}>, n_tokens array<long>, n_ids long, "
          "levels array<binary>, bitmaps array<binary>, ranks array<binary>")


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, write the ids to ``path`` in ascending order of ``id_col``."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = _FILES.format(id=id_type.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        words = _words(vocabulary)
        docs_held, raw, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            values = np.concatenate(raw)
            row = {"part": part, "shard": shard, "doc_ids": docs_held, "n_tokens": np.concatenate(counts).tolist(), "n_ids": len(values), **Dac.of(values).pack()}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([
                ("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("n_tokens", pa.list_(pa.int64())),
                ("n_ids", pa.int64()), ("levels", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])
            docs, (which, begins, (pool, starts, sizes)) = batch.column(0).to_pylist(), words.encode(batch.column(1))
            for i in range(0, len(docs), GATHER_DOCS):
                upto = min(i + GATHER_DOCS, len(docs))
                own = which[begins[i] : begins[upto]]
                ends = np.concatenate([[0], np.cumsum(sizes[own])])
                n = np.diff(ends[begins[i : upto + 1] - begins[i]])
                # the end id goes behind each document's ids
                ids = np.insert(_stretches(pool, starts[own], sizes[own]), np.cumsum(n), end_id)
                if raw and held + len(ids) > SHARD_IDS:
                    yield flush()
                    docs_held, raw, counts, held, shard = [], [], [], 0, shard + 1
                docs_held += docs[i:upto]
                raw.append(ids)
                counts.append(n + 1)
                held += len(ids)
        if raw:
            yield flush()

    placed = (docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
              .repartitionByRange("id").sortWithinPartitions("id", "text"))
    with bounded_batches(docs.sparkSession, BATCH_BYTES):
        placed.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def _shard_starts(files: DataFrame) -> DataFrame:
    """part, shard, shard_start: the number of ids before each shard."""
    sizes = files.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per file part: as many as the writer had partitions, however many documents there are
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.join(before, "part")
            .select("part", "shard", (F.col("before_part") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("shard_start")))


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    files = spark.read.schema(_FILES.format(id=id_type)).parquet(path)
    starts = _shard_starts(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = Dac.unpack(row["levels"], row["bitmaps"], row["ranks"], row["n_ids"]).all().astype("<u4")
                counts = np.asarray(row["n_tokens"], np.int64)
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(raw[e - n : e].tobytes()) for n, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(counts), pa.int32()), pa.array([row["shard"]] * len(counts), pa.int32()),
                     pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"])

    read = files.mapInArrow(run, f"part int, shard int, doc_id {id_type}, offset long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_at(files: DataFrame, positions: DataFrame) -> DataFrame:
    """Single ids by (part, shard, position in the shard): reads one code per level through the rank directories."""
    ship(files.sparkSession)

    @F.pandas_udf("long")
    def get(levels, bitmaps, ranks, n, at):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([Dac.unpack(list(a), list(b), list(c), d)[e] for a, b, c, d, e in zip(levels, bitmaps, ranks, n, at)])

    return files.join(positions, ["part", "shard"]).select(
        "part", "shard", "position", get("levels", "bitmaps", "ranks", "n_ids", "position").alias("token"))


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Ids by their number in the whole corpus, counted from 0 over all documents in order: from rows (position) to (position, token), null behind the
    last id. The shards, in order of their first ids, are met by an as-of join; of a shard only the codes asked for are read."""
    files = spark.read.schema(_FILES.format(id=id_type)).parquet(path)
    asked = positions.select(F.lit(0).alias("one"), F.col("position").cast("long").alias("position"))
    shards = _shard_starts(files).select(F.lit(0).alias("one"), "part", "shard", "shard_start")
    met = asof_join(asked, shards, "one", "position", "shard_start").select("position", "found.part", "found.shard", (F.col("position") - F.col("found.shard_start")).alias("at"))
    sizes = files.select(F.col("part").alias("s_part"), F.col("shard").alias("s_shard"), "n_ids")
    inside = met.join(sizes, (met["part"] == sizes["s_part"]) & (met["shard"] == sizes["s_shard"]), "left").select(
        F.col("position").alias("asked"), "part", "shard", F.when((F.col("at") >= 0) & (F.col("at") < F.col("n_ids")), F.col("at")).alias("position"))
    read = token_at(files, inside.where("position IS NOT NULL").select("part", "shard", "position").distinct())
    keys = ["part", "shard", "position"]
    return inside.join(read, keys, "left").select(F.col("asked").alias("position"), "token")

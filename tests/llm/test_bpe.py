import hashlib
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkloom.llm import bpe, token_files
from linkloom.llm.token_files import Dac
from linkloom.session import scratch_path

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", " ", "a  b\n\n c\t", "I'll don't they've", "x" * 3000, "ÀÉÎ ﬁ ½ ① 漢字かな", "\U0001F468‍\U0001F469 é İstanbul ΑΣ.", "a<|endoftext|>b <|startoftext|>", "12345 3.14 -- ... ,,, a.b.c. end.",
       "tab\x0bform\x0cfeed\x1cfs\x85nel\xa0nbsp", "<|ENDOFTEXT|> <| x", "straße, CAFÉ. naïve.", "क़ ̈́"]


def test_bpe_matches_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.round_trip(docs, BYTES, with_ids=True).collect()}
    for i, text in enumerate(ODD):
        ids = library.encode(text, add_special_tokens=False).ids
        assert rows[i].token_ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = docs.select("text", bpe.decoded(bpe.encoded(F.col("text"), BYTES), BYTES).alias("back")).collect()
    assert all(r.text == r.back for r in both)


def test_bpe_hard_rows(spark, hard, nothing, hard_rows):
    out = bpe.round_trip(hard, BYTES).collect()
    assert len(out) == len(hard_rows)
    assert {r.n_tokens for r in out if r.doc_id in (0, 1)} == {0}
    assert bpe.round_trip(nothing, BYTES).count() == 0
    lost = spark.createDataFrame([([5, 10**6, 7],), (None,)], "ids array<int>").select(bpe.decoded(F.col("ids"), BYTES).alias("t")).collect()
    assert lost[1].t == "" and len(lost[0].t) == 2


def test_merge_skips_stale_entries():
    model = bpe.load(BYTES)
    library = Tokenizer.from_file(BYTES)
    for text in ("aaaaaaaaaaaaa", "abababababab", "thethethethe", "........", "mississippi" * 5):
        assert list(model.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_directly_addressable_codes():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 511, 512, 513, 3000):
        for top in (1, 200, 256, 60000, 2**31):
            ids = rng.integers(0, top, n).astype(np.uint32)
            dac = Dac.of(ids)
            back = Dac.unpack(**dac.pack(), n=n)
            assert (back.all() == ids).all()
            for i in {0, n - 1, n // 2, n // 3}:
                assert back[i] == ids[i]


def _expected(rows, library):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 40)
    library = Tokenizer.from_file(WORDS)
    rows = [(i * 7 % 64, ODD[i % len(ODD)]) for i in range(64)]
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS, path, 2)
    got = sorted(tuple(r) for r in token_files.read_tokens(spark, path).collect())
    assert got == sorted(_expected(rows, library))
    files = spark.read.parquet(path)
    first = files.orderBy("part", "shard").head()
    ids = [i for d in first.doc_ids for i in library.encode(dict(rows)[d], add_special_tokens=False).ids + [2]]
    at = spark.createDataFrame([(first.part, first.shard, i) for i in range(first.n_ids)], "part int, shard int, position long")
    assert [r.token for r in token_files.token_at(files, at).orderBy("position").collect()] == ids


def test_tokens_by_their_number_in_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 40)
    library = Tokenizer.from_file(WORDS)
    rows = [(i * 7 % 64, ODD[i % len(ODD)]) for i in range(64)]
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS, path, 2)
    ids = [i for _, text in sorted(rows) for i in library.encode(text or "", add_special_tokens=False).ids + [2]]
    asked = [*range(len(ids)), 5, 5, -1, len(ids), len(ids) + 1000]
    got = token_files.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((p, ids[p] if 0 <= p < len(ids) else None) for p in asked), key=str)


def test_token_files_hard_rows(spark, hard, nothing, hard_rows):
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(hard, WORDS, path, 2)
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert got == _expected([r[:2] for r in hard_rows], Tokenizer.from_file(WORDS))
    path = scratch_path(spark, "test-tokens")
    token_files.write_tokens(nothing, WORDS, path, 2)
    assert token_files.read_tokens(spark, path).count() == 0

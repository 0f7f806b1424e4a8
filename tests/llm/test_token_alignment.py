import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkloom.llm import token_alignment as ta
from linkloom.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def paths():
    return vocabulary(A), vocabulary(B)


def _tokens(paths, text):
    """Whole-text ids and token bytes of both libraries, or nothing."""
    both = ta.load(*paths)
    if not text:
        return [], [], [], []
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    spelled_a = [bytes(map(_BYTE.__getitem__, both.a.id_to_token(i))) for i in a]
    spelled_b = [bytes([int(p[3:-1], 16)]) if both.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [both.b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (a, b, spelled_a, spelled_b) if b"".join(spelled_a) == whole == b"".join(spelled_b) else ([], [], [], [])


_BYTE = {c: i for i, c in enumerate(ta.byte_symbols())}


def brute(paths, rows):
    held, pairs = [], Counter()
    for doc, text in rows:
        a, b, sa, sb = _tokens(paths, text)
        ends_a = {e: k for k, e in enumerate(np.cumsum([len(x) for x in sa]).tolist())} if a else {}
        ends_b = {e: k for k, e in enumerate(np.cumsum([len(x) for x in sb]).tolist())} if b else {}
        links = [(a[ends_a[e]], b[ends_b[e]]) for e in sorted(set(ends_a) & set(ends_b))]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(map(str, a[i:ends_a[e] + 1])) + "|" + ",".join(map(str, b[j:ends_b[e] + 1])))
            i, j = ends_a[e] + 1, ends_b[e] + 1
        pairs.update(links)
        held.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return sorted(((d, na, nb, ng, len(ls), sum(pairs[p] == most[p[1]] for p in ls), sum(pairs[p] for p in ls), h) for d, na, nb, ng, ls, h in held), key=str)


HOSTILE = [None, "", " ", "  ", "a", " a", "a ", "a\n b", "a \n b", "a\n\n  b  c", "x  y  z", "▁ x", "a▁b", "<s> </s> <unk> <|endoftext|> <0x0A>", "漢字 かな 😀 é ﬁ",
           "can't  we'll\t\tdo\r\nit", "\x00\x01 \x7f", "1234567890 12,345.67", "ab1c" * 3000, "word " * 500, "　 x ​ y", "a\x1c b\x1f  c", "a \x85 b  c", "   lead  and trail   "]


def test_equals_brute_force(spark, paths):
    rng = random.Random(3)
    alphabet = "abc ABé\n\t 漢'1.▁ "
    rows = list(enumerate(HOSTILE)) + [(100 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(paths, rows)
    for bound in (ta.BROADCAST_PAIRS, 0):
        assert sorted(map(tuple, ta.align_tokenizers(docs, *paths, broadcast_pairs=bound).collect()), key=str) == want


def test_documents_equal_brute_force(spark, sf_small, paths):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = brute(paths, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, ta.align_tokenizers(docs, *paths).collect()), key=str) == want


@pytest.mark.parametrize("piece", [1, 2, 7, 128, 10_000])
def test_pieces_of_any_size_merge_alike(piece):
    rng = random.Random(piece)
    for _ in range(40):
        total = rng.randint(1, 300)
        a, b = (np.array(sorted(set(rng.sample(range(1, total + 1), rng.randint(0, total - 1))) | {total})) for _ in range(2))
        i, j, together = ta.merge_ends(a, b, piece)
        spans = [list(zip([0, *x[:-1].tolist()], x.tolist())) for x in (a, b)]
        overlaps = [(p, q) for p, (s, e) in enumerate(spans[0]) for q, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert list(zip(i.tolist(), j.tolist())) == overlaps
        assert [bool(t) for t in together] == [bool(a[p] == b[q]) for p, q in overlaps]
        x, y = ta.crossings(a, b, piece)
        assert (x + y == np.arange(0, len(a) + len(b), piece)).all()


def test_groups_spell_the_same_bytes(spark, paths):
    both = ta.load(*paths)
    docs = spark.createDataFrame([(1, "Unbelievable thorough-going words"), (2, None)], "doc_id long, text string")
    rows = {r.id: r for r in ta.alignments(docs, *paths, with_groups=True).collect()}
    assert rows[2].a_ids == [] and rows[2].groups_sha256 == ""
    r, i, j = rows[1], 0, 0
    for x, y in zip(r.a_ends, r.b_ends):
        assert b"".join(both.a_bytes[k] for k in r.a_ids[i:x]) == b"".join(both.b_bytes[k] for k in r.b_ids[j:y])
        i, j = x, y
    assert (i, j) == (r.n_a, r.n_b) and len(r.a_ends) == r.n_groups


def test_hard_rows(hard, nothing, hard_rows, paths):
    got = ta.align_tokenizers(hard, *paths)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(paths, [(r[0], r[1]) for r in hard_rows])
    assert ta.align_tokenizers(nothing, *paths).count() == 0

"""Exact de-duplication by deterministic block naming.

A normalised text (white-space runs become one space) is cut into blocks of ``BLOCK`` code points. Distinct blocks
are sorted and get integer names; equal blocks get equal names, different blocks different ones. Then adjacent names
are paired, the distinct pairs are sorted and named in turn, and so on until each document has one integer. With the
number of rounds, that integer is the text's identity, without collisions.

Sorting is spread over hash buckets, as many as there are documents: a block's name is (its rank among the sorted
distinct blocks of its bucket) * buckets + bucket. It depends on the data alone, so that a rerun gives the same name.
Copies are merged before the shuffle (partial aggregation), so that a block that a third of all rows share is one row a task.

The names meet the documents through a 64-bit hash of the block. Whether two different blocks share a hash is known
from the sorted buckets, which hold the blocks themselves; if any do, those are told apart by their content.

Defined cases: a null text is the empty text; empty texts are copies of each other; rows that repeat a document id
count one by one, and of rows that are equal in id and text one stays; null ids come after all others. Other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import SPACES, as_text, fresh, written

BLOCK = 4096
#: At most so many dropped rows are broadcast by ``deduplicated``; above, the join shuffles.
BROADCAST_ROWS = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(as_text(text), SPACES, " ")


def _named(values: DataFrame, buckets: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """Integer names of the distinct values of column ``value``: value, h (its hash), name, clash (another value has h)."""
    sets = values.select("value", F.pmod(hashed(F.col("value")), F.lit(buckets)).alias("bucket"))
    ranked = sets.groupBy("bucket").agg(F.array_sort(F.collect_set("value")).alias("ranked"))
    hashes = F.transform("ranked", lambda v: hashed(v))
    flagged = ranked.withColumn("clash", F.size(F.array_distinct(hashes)) < F.size("ranked"))
    return (flagged.select("bucket", "clash", F.posexplode("ranked").alias("rank", "value"))
            .select("value", hashed(F.col("value")).alias("h"), "clash", (F.col("rank").cast("long") * F.lit(buckets) + F.col("bucket")).alias("name")))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
               hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: id, sha (binary SHA-256 of the normalised text), level, name. Equal (level, name)
    means equal normalised texts, and the other way round."""
    buckets = 1 << max(10, docs.count().bit_length())
    base = docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("t"))
    cut = F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    pieces = base.select("id", "t", cut.alias("blocks"))

    names = _named(pieces.select(F.explode("blocks").alias("value")), buckets, hashed)
    names = written(names.select("h", "name", F.when(F.col("clash"), F.col("value")).alias("content")), "block-names")
    clashes = bool(names.where(F.col("content").isNotNull()).head(1))

    parts = pieces.select("id", F.unhex(F.sha2("t", 256)).alias("sha"), F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "value"))
    parts = parts.select("id", "sha", "n", "pos", hashed(F.col("value")).alias("h"), *(["value"] if clashes else []))
    on = parts["h"] == names["h"]
    if clashes:
        on &= names["content"].isNull() | (names["content"] == parts["value"])
    placed = written(parts.join(names, on).select("id", "sha", "n", "pos", "name"), "placed-names")

    done = [placed.where("n = 1").select("id", "sha", F.lit(0).alias("level"), "name", F.lit(1).cast("long").alias("copies"))]
    todo = _collected(placed.where("n > 1").withColumn("rows", (F.col("pos") == 0).cast("long")))
    longest = placed.agg(F.max("n")).head()[0] or 1
    for level in range(1, (longest - 1).bit_length() + 1):
        pairs = todo.select("id", "sha", "copies", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.size("names") - 1, F.lit(2)),
            lambda i: F.struct(F.get("names", i).alias("a"), F.coalesce(F.get("names", i + 1), F.lit(-1)).alias("b")))).alias("pos", "value"))
        named = _named(pairs.select("value"), buckets, F.xxhash64).select("value", "name")
        step = written(pairs.join(named, "value").select("id", "sha", "copies", "pos", "name"), f"names-{level}")
        todo = _collected(step.withColumn("rows", F.when(F.col("pos") == 0, F.col("copies")).otherwise(0)))
        ended = todo.where("size(names) = 1").select("id", "sha", F.lit(level).alias("level"), F.col("names")[0].alias("name"), "copies")
        done.append(ended)
        todo = todo.where("size(names) > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _collected(parts: DataFrame) -> DataFrame:
    """The names of each document in order. Rows equal in id and text are one here, counted in ``copies``."""
    return (parts.groupBy("id", "sha").agg(F.array_sort(F.collect_set(F.struct("pos", "name"))).alias("p"), F.sum("rows").alias("copies"))
            .select("id", "sha", F.col("p.name").alias("names"), "copies"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                     hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    known = identities(docs, id_col, text_col, block, hashed)
    known = known.groupBy("level", "name", "id", "sha").agg(F.sum("copies").alias("copies"))
    groups = known.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    joined = known.join(groups, ["level", "name"])
    rows = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
    return rows.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = written(exact_duplicates(docs, id_col, text_col), "exact-duplicates")
    a, b, c, d = (fresh(x) for x in ("id", "sha", "kid", "ksha"))
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias(a), F.col("text_sha256").alias(b))
    repeated = bool(found.groupBy(id_col, "text_sha256").count().where("count > 1").head(1))
    if repeated:  # rows of a document that stays are dropped below, one by one
        stay = found.where("kept").select(F.col(id_col).alias(c), F.col("text_sha256").alias(d))
        gone = gone.join(stay, gone[a].eqNullSafe(stay[c]) & (gone[b] == stay[d]), "left_anti").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    sha = F.sha2(normalised(docs[text_col]), 256)
    out = docs.join(gone, docs[id_col].eqNullSafe(gone[a]) & (sha == gone[b]), "left_anti")
    if not repeated:
        return out
    return out.withColumn(b, F.sha2(normalised(out[text_col]), 256)).dropDuplicates([id_col, b]).drop(b)


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""

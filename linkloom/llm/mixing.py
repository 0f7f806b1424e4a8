"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / w, where u is a uniform number hashed from its id and seed and w its
quality weight. Within a source, documents in ascending key order are a weighted sample without replacement. A
source's target is filled with complete epochs first; what is left is filled in key order, by prefix sums, up to the
token budget.

No source is ever sorted in one task. Keys are 60-bit integers, read 12 bits at a time: sizes are summed per
(source, digit), a prefix sum over the at most 4,096 digits of a source finds the digit in which the budget ends,
all smaller digits are taken whole, and only that digit's documents go on to the next 12 bits. After five rounds only
documents with one and the same key are left, which are taken in order of their ids.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; targets are 0 where all
sizes are 0; documents of size 0 are never taken; a null quality weight counts as 1; a repeated id has the same key
and is told apart by size; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import WORD, as_text, written

DIGIT_BITS = 12
DIGITS = 5
MAX_EPOCHS = 3
BROADCAST_SOURCES = 100_000
SEED = 20240917


def word_count(text: Column) -> Column:
    return F.regexp_count(as_text(text), F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """A cheap quality weight in [0.25, 1]: texts whose characters are letters, spaces and full stops weigh most."""
    t = as_text(text)
    n = F.length(t)
    plain = n - F.length(F.regexp_replace(t, r"[\p{L}\p{M}\x20.,]+", ""))
    return F.when(n == 0, F.lit(0.25)).otherwise(F.lit(0.25) + F.lit(0.75) * F.pow(plain / n, F.lit(4.0)))


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From rows (source, source_size) to (source, source_size, target). Sources in code point order, null last, weigh
    1, 2, 3, 1, 2, 3, ...; no target is above ``max_epochs`` times its source's size, and what is above is shared
    among the others by weight until none is.

    The final level is one number L (target = min(weight * L, cap)), found by filling sources in order of cap / weight:
    one sort of the table of sources, no iteration. That table has a row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    caps = sizes.select("source", "source_size", (1 + (F.row_number().over(order) - 1) % 3).cast("double").alias("w"),
                        (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_w = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    # with the sources before this one at their caps, the level of the rest
    level = caps.select("*", ((total - full) / open_w).alias("lev"), (F.col("cap") / F.col("w")).alias("at"))
    last = level.agg(F.coalesce(F.min(F.when(F.col("at") >= F.col("lev"), F.struct("at", "lev")))["lev"], F.lit(float("inf"))).alias("level"))
    # one row against the table of sources
    return (caps.withColumn("one", F.lit(1)).join(last.withColumn("one", F.lit(1)), "one")
            .select("source", "source_size", F.least(F.col("w") * F.col("level"), F.col("cap")).alias("target")))


def _keys(docs: DataFrame, id_col: str, source_col: str, text_col: str, quality: Column | None, seed: int) -> list[Column]:
    """id, source, size and key as columns of ``docs``."""
    top = DIGIT_BITS * DIGITS
    w = F.coalesce(quality if quality is not None else quality_weight(docs[text_col]), F.lit(1.0))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs[id_col].cast("string")), 11).cast("double") + 0.5) / float(1 << 53)
    share = 1 - F.exp(F.log(u) / F.greatest(w, F.lit(1e-6)))  # ascending in the key, between 0 and 1
    return [docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col]).alias("size"),
            F.least(F.floor(share * float(1 << top)).cast("long"), F.lit((1 << top) - 1)).alias("key")]


def _plan(rows: DataFrame, max_epochs: int) -> DataFrame:
    """A row per source: p_source, source_size, target, epochs, budget, and where in the order of keys the budget ends."""
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs)
    plan = wanted.select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"))
    plan = plan.withColumn("budget", F.when(F.col("epochs") >= max_epochs, F.lit(0)).otherwise(F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long"))
    plan = written(plan.withColumnRenamed("source", "p_source"), "mix-plan")

    # rounds of 12 bits: keys whose prefix is below the edge's are taken, left is the rest of the budget inside the edge
    edge = plan.select(F.col("p_source").alias("e_source"), F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for digit in range(1, DIGITS + 1):
        shift = DIGIT_BITS * (DIGITS - digit)
        inside = rows.join(edge, rows["source"].eqNullSafe(edge["e_source"]) & (F.shiftright("key", shift + DIGIT_BITS) == edge["prefix"]))
        sums = inside.groupBy("source", "left", F.shiftright("key", shift).alias("prefix")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("prefix"))
        found = (sums.select("source", "prefix", (F.col("left") - upto + F.col("n")).alias("left"), (upto > F.col("left")).alias("over"))
                 .where("over").groupBy("source").agg(F.min(F.struct("prefix", "left")).alias("e"))
                 .select(F.col("source").alias("e_source"), "e.prefix", "e.left"))
        edge = written(found, f"mix-edge-{digit}")
    # documents with the very key in which the budget ends: by id, as long as they fit; the first that does not fit
    # is taken too if that comes nearer to the budget
    tied = rows.join(edge, rows["source"].eqNullSafe(edge["e_source"]) & (rows["key"] == edge["prefix"]))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1))
    start = tied.select("source", "id", "size", F.coalesce(upto, F.lit(0)).alias("from"), "left")
    nearer = F.col("from") + F.col("size") - F.col("left") < F.col("left") - F.col("from")
    closes = (start.groupBy("source").agg(F.min(F.when(F.col("from") + F.col("size") > F.col("left"), F.struct("id", "size", nearer.alias("nearer")))).alias("x"))
              .select(F.col("source").alias("x_source"), F.col("x.id").alias("x_id"), F.col("x.size").alias("x_size"), F.col("x.nearer").alias("x_nearer")))
    ends = (plan.join(edge, F.col("p_source").eqNullSafe(F.col("e_source")), "left").join(closes, F.col("p_source").eqNullSafe(F.col("x_source")), "left")
            .select("p_source", "source_size", "target", "epochs", "budget", "prefix", "x_id", "x_size", "x_nearer"))
    return written(ends, "mix-ends")


def _copies(id_col: Column, size: Column, key: Column) -> Column:
    """How often the mix takes a document whose row has met its source's plan."""
    own, closing = F.struct(id_col.alias("id"), size.alias("size")), F.struct(F.col("x_id").alias("id"), F.col("x_size").alias("size"))
    fits = F.col("x_size").isNull() | (own < closing) | (own.eqNullSafe(closing) & F.col("x_nearer"))
    extra = (F.col("budget") > 0) & (F.col("prefix").isNull() | (key < F.col("prefix")) | ((key == F.col("prefix")) & fits))
    return F.when(size > 0, F.col("epochs") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        quality: Column | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    rows = written(docs.select(*_keys(docs, id_col, source_col, text_col, quality, seed)), "mix-keys")
    ends = _plan(rows, max_epochs)
    return rows.join(ends, rows["source"].eqNullSafe(ends["p_source"])).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * _copies(F.col("id"), F.col("size"), F.col("key"))).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          quality: Column | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Texts are not shuffled while the table of sources
    has at most ``BROADCAST_SOURCES`` rows."""
    columns = _keys(docs, id_col, source_col, text_col, quality, seed)
    rows = written(docs.select(*columns), "mix-keys")
    ends = _plan(rows, max_epochs)
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *columns)
    met = own.join(ends, own["source"].eqNullSafe(ends["p_source"]))
    copies = _copies(F.col("id"), F.col("size"), F.col("key"))
    return met.select("row", copies.alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

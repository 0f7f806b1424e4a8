"""Sharding by minimax contiguous partition.

Documents with equal texts are one group and stay together; its size is that of its rows. Groups are in order of the SHA-256 of their
texts, so that the order follows from each row alone: no table of groups is joined back, and the rows of a large group, which are in order of
their ids, may lie in many tasks. The shards are stretches of this order. The smallest capacity C for which a greedy walk (fill a shard while the
next group fits) needs no more than the wanted number of shards is found by binary search; then the order is cut so that no shard is
above C and, within that, groups above the mean have shards of their own and the others come near to the mean of what is left.

The walk asks 40 times a step for the last group that ends at or before an offset. It asks a summary of at most ``SUMMARY`` blocks of
the order, which keeps the first and the last end of each. Where unknown ends lie between the two, the answer is bounded from both
sides, and so is C. As long as the bounds differ, the stretches in which the walks of the open capacities end are summarised again, in blocks at least
16 times smaller in practice, until C is exact. That many numbers, and no more, reach the driver, however large the table.

What is moved: 56 bytes and the id for each row, twice (range sort, running sums); texts are read once and, if files are written, moved once.
DataFrame functions only; the search itself is arithmetic over the summary.

Defined cases: a null text counts as empty; an id may be of any type that can be sorted, null ids come first, repeated rows have a
slot each; with fewer groups than shards some shards stay empty, and a group larger than the mean gets a shard of its own or one that it
shares with its neighbours as far as C allows; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import operator
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import as_text, written

SHARDS = 40
OVERHEAD = 16
SUMMARY = 1 << 16


def name_of(text: Column) -> Column:
    return F.unhex(F.sha2(as_text(text), 256))


def placed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Rows in order of (name of text, id): id, size, text_crc32, name, begin (bytes before the row), place (rows before it) and closes
    (whether it is the last of its group)."""
    text = as_text(docs[text_col])
    rows = written(docs.select(docs[id_col].alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                               name_of(docs[text_col]).alias("name")), "shard-rows")
    keys = ["name", "id", "size"]
    listed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    listed = written(listed.withColumns({"task": F.spark_partition_id(), "number": F.monotonically_increasing_id()}), "shard-order")
    # one row for every task of the range sort
    tasks = listed.groupBy("task").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("number").alias("first"), F.min("name").alias("name"))
    order = Window.orderBy("task")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("task", "first", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.lead("name").over(order).alias("name_behind"))
    inside = Window.partitionBy("task").orderBy("number")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = listed.select("*", upto.alias("upto"), F.lead("name").over(inside).alias("following"))
    joined = summed.join(offsets, "task")
    return written(joined.select("id", "size", "text_crc32", "name", (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("begin"),
                                 (F.col("rows_before") + F.col("number") - F.col("first")).alias("place"),
                                 (~F.coalesce("following", "name_behind").eqNullSafe(F.col("name"))).alias("closes")), "shard-places")


@dataclass
class Known:
    """Ends of groups that are known, in order, from 0 to the total; behind which of them unknown ends may lie before the next."""

    ends: list[int]
    open: list[bool]

    def floor(self, x: int) -> int:
        return self.ends[bisect_right(self.ends, x) - 1]

    def above(self, x: int) -> int:
        """No end at or before x is larger."""
        at = bisect_right(self.ends, x) - 1
        return x if self.open[at] else self.ends[at]

    def walk(self, capacity: int, shards: int, floor) -> list[int]:  # noqa: ANN001
        """Where the shards of a greedy walk end."""
        total, out = self.ends[-1], [0]
        for _ in range(shards):
            out.append(min(floor(out[-1] + capacity), total))
        return out

    def least(self, shards: int, floor, low: int, high: int) -> int:  # noqa: ANN001
        """Binary search: the smallest capacity in (low, high] with which a walk reaches the end."""
        while high - low > 1:
            middle = (low + high) // 2
            if self.walk(middle, shards, floor)[-1] >= self.ends[-1]:
                high = middle
            else:
                low = middle
        return high

    def replaced(self, windows: list[tuple[int, int]], blocks: list[tuple[int, int, int]]) -> Known:
        """With the windows known by new blocks (first end, last end, number of ends)."""
        held = {e: o for e, o in zip(self.ends, self.open) if e == 0 or not any(a <= e < b for a, b in windows)}
        for first, last, n in blocks:
            held[last] = False
            if n > 1:
                held[first] = n > 2
        ends = sorted(held)
        return Known(ends, [held[e] for e in ends])


def _summary(ends: DataFrame, shift: int, windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The ends in the windows by blocks of 2 ** shift bytes."""
    inside = ends.where(functools.reduce(operator.or_, [(F.col("end") >= a) & (F.col("end") < b) for a, b in windows]))
    blocks = inside.groupBy(F.shiftright("end", shift).alias("block")).agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n"))
    return [(r["first"], r["last"], r["n"]) for r in blocks.collect()]


def smallest_capacity(ends: DataFrame, total: int, shards: int, summary: int = SUMMARY) -> tuple[int, Known]:
    """From a table of the offsets at which groups end: the smallest feasible capacity, and ends enough to cut by it."""
    shift = max(0, (total // summary).bit_length())
    known = Known([0], [False]).replaced([], _summary(ends, shift, [(0, total + 1)]))
    while True:
        low = -(-total // shards) - 1
        surely = known.least(shards, known.floor, low, total)
        possibly = known.least(shards, known.above, low, surely)
        if possibly == surely:
            return surely, known
        # where walks of the capacities from possibly to surely look for an end, in whole blocks
        starts, stops = known.walk(possibly, shards, known.floor), known.walk(surely, shards, known.above)
        windows: list[tuple[int, int]] = []
        for a, b in zip(starts, stops):
            a, b = (min(a + possibly, total) >> shift) << shift, ((min(b + surely, total) >> shift) + 1) << shift
            if windows and a <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(windows[-1][1], b))
            else:
                windows.append((a, b))
        width = sum(b - a for a, b in windows)
        shift = max(0, min(shift - 1, (width // summary).bit_length()))
        known = known.replaced(windows, _summary(ends, shift, windows))


def _large_groups(ends: list[int], shards: int) -> list[tuple[int, int]]:
    """Groups above the mean of the shards that are left when each of them has one of its own, in order. A group larger than a block of the
    summary has both its bounds in it."""
    gaps = sorted(zip(ends, ends[1:]), key=lambda g: g[0] - g[1])
    rest, n = ends[-1], 0
    while n < min(shards - 1, len(gaps)) and gaps[n][1] - gaps[n][0] > rest / (shards - n):
        rest -= gaps[n][1] - gaps[n][0]
        n += 1
    return sorted(gaps[:n])


def even_cuts(known: Known, capacity: int, shards: int) -> list[int]:
    """shards - 1 offsets to cut at: no shard above the capacity, large groups in shards of their own as far as that leaves enough, and
    the others as near as may be to the mean of what is left."""
    ends, total = known.ends, known.ends[-1]
    earliest = [total]
    for _ in range(shards):
        earliest.append(ends[bisect_left(ends, earliest[-1] - capacity)])
    earliest.reverse()
    large = _large_groups(ends, shards)
    stretches = [start - stop for stop, start in zip([0, *[b for _, b in large]], [*[a for a, _ in large], total])]
    # a shard for every stretch between large groups, the others one by one to the stretch whose shards are largest
    given = [int(size > 0) for size in stretches]
    for _ in range(shards - len(large) - sum(given)):
        most = max(range(len(stretches)), key=lambda k: stretches[k] / max(given[k], 1))
        given[most] += 1
    cuts, stretch = [0], 0
    for k in range(1, shards):
        here = cuts[-1]
        if here == total:
            cuts.append(total)
            continue
        while stretch < len(large) and large[stretch][1] <= here:
            stretch += 1
        start, stop = large[stretch] if stretch < len(large) else (total, total)
        mean = stretches[stretch] / max(given[stretch], 1)
        left = max(1, round((start - here) / mean)) if mean else 1
        if start <= here:
            near = stop
        elif start - here < sum(stretches) / (2 * max(shards - len(large), 1)) and stop - here <= capacity:
            near = stop  # a small rest shares the large group's shard
        else:
            aim = here + (start - here) / left
            at = bisect_left(ends, aim)
            near = min(ends[max(at - 1, 0):at + 1], key=lambda e: abs(e - aim))
        low = max(earliest[k], ends[bisect_right(ends, here)])
        cuts.append(min(max(near, low), known.floor(here + capacity)))
    return cuts[1:]


def _cut(placed: DataFrame, shards: int, summary: int) -> list[int]:
    ends = placed.where("closes").select((F.col("begin") + F.col("size")).alias("end"))
    total = ends.agg(F.max("end")).head()[0]
    if not total:
        return [0] * (shards - 1)
    capacity, known = smallest_capacity(ends, total, shards, summary)
    return even_cuts(known, capacity, shards)


def _count_below(marks: list[Column], value: Column) -> Column:
    return functools.reduce(operator.add, [(value >= m).cast("int") for m in marks], F.lit(0))


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD, summary: int = SUMMARY) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (the law is ``bytes``: a further shard moves others, so null)."""
    placed = placed_rows(docs, id_col, text_col, overhead)
    cuts = _cut(placed, shards, summary)
    rows = placed.withColumn("shard", _count_below([F.lit(c) for c in cuts], F.col("begin")))
    first = rows.groupBy("shard").agg(F.min("place").alias("first_place"))  # a row per shard
    return rows.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first_place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD, summary: int = SUMMARY) -> str:
    """Write the documents, whole, as Parquet folders of a shard each, in order of their slots. The shard of a text follows from its name and
    the names that open the shards, so texts are moved once and joined with nothing. Returns the name of the folders' column: ``shard``, with as
    many underscores before it as it takes to differ from the columns of ``docs``."""
    placed = placed_rows(docs, id_col, text_col, overhead)
    cuts = _cut(placed, shards, summary)
    shard = _count_below([F.lit(c) for c in cuts], F.col("begin"))
    opening = {r["shard"]: bytes(r["name"]) for r in placed.groupBy(shard.alias("shard")).agg(F.min("name").alias("name")).collect()}
    # a shard without rows opens where the next does
    marks, following = [], b"\xff" * 33
    for k in range(shards - 1, 0, -1):
        following = opening.get(k, following)
        marks.append(F.lit(bytearray(following)))
    column = "shard"
    while column.lower() in {c.lower() for c in docs.columns}:
        column = f"_{column}"
    rows = docs.withColumn(column, _count_below(marks, name_of(docs[text_col])))
    keys = [F.col(column), name_of(F.col(text_col)), F.col(id_col)]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy(column).parquet(path)
    return column

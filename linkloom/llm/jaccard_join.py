"""N-gram Jaccard join in metric space.

Documents are sets of ``SHINGLE``-word shingles; two link when their Jaccard distance is at most eps = 1 - ``PERCENT``/100. The join is
exact and proceeds from coarse regions to fine ones:

1. Sizes. Pivots on the size axis (a geometric series) make Voronoi regions. As linked sets differ in size by at most a factor
   PERCENT/100, a document is replicated into the next region exactly if it lies within that window of its border.
2. Projections. Documents as pivots of the whole space would not part anything: unrelated documents all lie at distance 1 of
   each other, hence in every window. Projections of a set do part them. In a size region linked sets differ in at most T elements; a hash deals the elements into more
   than T + 1 parts, so that linked sets are equal in all but T of their parts. A part's content is the pivot of a cell of radius 0,
   in which a document lies; equal contents put documents into the same cell. Cells of one document are done, and a document
   is done that shares fewer non-empty cells than its own count less T, for no link of it can be missing so many.
3. Documents that still share cells form regions (connected components of documents and cells within a size region); each
   document's set goes to its regions, one or two. A region is joined by recursion on pivots: a pivot's distances to all others are counted exactly, what lies within eps is linked to it,
   and a pair (x, y) is looked at later only if x and y are not connected yet and the triangle inequality allows a link:
   |d(x, p) - d(y, p)| <= eps for every pivot p before.
4. A region too large for a task takes the same steps as Spark jobs: the pivot's core within eps is linked and split off, the
   remainder within the window 2 eps is joined with the core in blocks, the rest becomes a region of its own; what stays large after
   ``ROUNDS`` pivots is joined block against block.

Equal sets are one node from the start, whatever their number. Cells are placed by range over (cell, node), so that a crowded cell
is spread over tasks. They are shuffled in ``PASSES`` passes, each with the cells of one remainder by ``PASSES``; a pass's shuffle files go before the next
begins, so that no more than one part of all (cell, node) rows lies in shuffle files at a time. Shingles are told apart by 64-bit hashes; a collision of the 64-bit hashes of two sets is
detected by a second hash and answered by another seed.

Defined cases: null, empty or blank texts have no shingles and link with nothing; fewer words than ``SHINGLE`` make one shingle; rows that
repeat an id are documents of their own, which share the id; of a component the smallest id names it (nulls are ignored, a component of null ids has a null name); other columns play
no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import fresh, release, ship, small_batches, written, written_at
from linkloom.llm.graph import components
from linkloom.session import drop_scratch

SHINGLE = 5
PERCENT = 80
GROWTH = 1.4
#: Parts above T + 1, as a share of it and at least: the more, the more cells linked documents must share. Small documents would
#: otherwise need only one or two, and tie unrelated families together by a common phrase.
PARTS = 1.25
MORE_PARTS = 24
BUFFER = 1_000_000
CACHE_WORDS = 150_000
#: Passes over the cells; a table of at most so many shingles takes one.
PASSES = 4
PASS_SHINGLES = 1_000_000
#: A region of more documents or shingles is split by Spark jobs.
REGION_DOCS = 8_000
REGION_SHINGLES = 1_500_000
TASK_SHINGLES = 500_000
ROUNDS = 3
SALTS = 64
#: At most so many ids of documents to fetch are broadcast.
BROADCAST_IDS = 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(left: np.ndarray, right: np.ndarray | np.uint64) -> np.ndarray:
    h = left * _A + right
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, in order of (text, hash): numbers of the texts, hashes."""
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((_HASHES[w] for ws in words for w in ws), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    if len(flat) >= width:
        h = _pair(flat[: len(flat) - width + 1], np.uint64(width))
        for k in range(1, width):
            h = _pair(h, flat[k : len(flat) - width + 1 + k])
        doc = doc[: len(h)]
        whole = np.arange(len(h)) + width <= ends[doc]
        doc, h = doc[whole], h[whole]
    else:
        doc, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        short = np.array([xxhash.xxh64_intdigest(b" ".join(words[i]), seed=1) for i in few], np.uint64)
        doc, h = np.concatenate([doc, few]), np.concatenate([h, short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, bool)
    return doc[new], h[new]


class Sizes:
    """Size regions: borders, most differing elements, numbers of parts."""

    def __init__(self, percent: int, growth: float = GROWTH, parts: float = PARTS):
        borders = [1]
        while borders[-1] < 1 << 40:
            borders.append(max(borders[-1] + 1, int(borders[-1] * growth)))
        self.percent, self.borders = percent, np.array(borders, np.int64)
        # 100 * I >= percent * (a + b - I)  =>  |A xor B| = a + b - 2 I <= (a + b) * (100 - percent) / (100 + percent)
        self.differ = 2 * (self.borders[1:] - 1) * (100 - percent) // (100 + percent)
        self.parts = np.maximum(np.ceil(parts * (self.differ + 1)), self.differ + 1 + MORE_PARTS).astype(np.int64)

    def regions(self, n: int) -> list[int]:
        """The region of a set of n elements, and those above that it may have larger partners in."""
        home = int(np.searchsorted(self.borders, n, "right")) - 1
        found, above = [home], home + 1
        while self.percent * int(self.borders[above]) <= 100 * n:
            found.append(above)
            above += 1
        return found


def _sums(code: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit values by code, modulo 2**64; halves are exact in floating point up to 2**21 values a code."""
    low = np.bincount(code, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), size).astype(np.uint64)
    high = np.bincount(code, (values >> np.uint64(32)).astype(np.float64), size).astype(np.uint64)
    return low + (high << np.uint64(32))


def describe(texts: list[bytes], seed: int, sizes: Sizes, seen: set[int], width: int = SHINGLE) -> list[dict]:
    """Per text: n, node (hash of the set), check (another), cells: list of (need, signatures); none for nodes seen before."""
    doc, h = shingle_sets(texts, width)
    n = np.bincount(doc, minlength=len(texts))
    one, two = _pair(h, np.uint64(2 * seed + 101)), _pair(h, np.uint64(2 * seed + 102))
    node = _pair(_sums(doc, one, len(texts)), n.astype(np.uint64)).view(np.int64)
    check = _pair(_sums(doc, two, len(texts)), n.astype(np.uint64)).view(np.int64)
    place, content = _pair(h, np.uint64(11)) >> np.uint64(32), _pair(h, np.uint64(12))
    starts = np.concatenate([[0], np.cumsum(n)])
    rows = []
    todo: list[tuple[int, int]] = []
    for i in range(len(texts)):
        rows.append({"n": int(n[i]), "node": int(node[i]) if n[i] else None, "check": int(check[i]) if n[i] else None, "cells": []})
        if n[i] and int(node[i]) not in seen:
            seen.add(int(node[i]))
            todo += [(i, r) for r in sizes.regions(int(n[i]))]
    if not todo:
        return rows
    owner, region = np.array(todo, np.int64).T
    parts = sizes.parts[region]
    base = np.concatenate([[0], np.cumsum(parts)])
    count = n[owner]
    # one element for every (document, region, shingle)
    at = np.repeat(starts[owner] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    pair = np.repeat(np.arange(len(owner)), count)
    code = base[pair] + ((place[at] * parts[pair].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    filled = np.bincount(code, minlength=base[-1])
    sums = _sums(code, content[at], base[-1])
    part = np.arange(base[-1]) - np.repeat(base[:-1], parts)
    where = np.repeat(region, parts)
    cell = _pair(_pair(sums, filled.astype(np.uint64)), (where * (1 << 40) + part).astype(np.uint64)).view(np.int64)
    for k, (i, r) in enumerate(todo):
        inside = filled[base[k] : base[k + 1]] > 0
        cells = cell[base[k] : base[k + 1]][inside]
        used, most = int(inside.sum()), int(sizes.differ[r])
        if used <= most:  # two such sets might agree in empty parts alone
            cells = np.append(cells, _pair(np.array([r], np.uint64), np.uint64(99)).view(np.int64))
        rows[i]["cells"].append({"region": r, "need": max(1, used - most), "cells": cells})
    return rows


_CELLS = "array<struct<region:int,need:int,cells:array<bigint>>>"
_PASS_COLUMNS = [f"cells_{k}" for k in range(PASSES)]


def _described(docs: DataFrame, seed: int, percent: int, width: int) -> DataFrame:
    """From rows (id, text): id, n, node, check, and the cells in a column for each pass."""
    id_field = docs.schema["id"]
    schema = T.StructType([id_field, *T._parse_datatype_string(", ".join(["n long, node long, check long", *(f"{c} {_CELLS}" for c in _PASS_COLUMNS)])).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, seen = Sizes(percent), set()
        cell_type = pa.list_(pa.struct([("region", pa.int32()), ("need", pa.int32()), ("cells", pa.list_(pa.int64()))]))

        def out(ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
            rows = describe(texts, seed, sizes, seen, width)
            flat = [c for r in rows for c in r["cells"]]
            cells = np.concatenate([c["cells"] for c in flat]) if flat else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(flat)), np.array([len(c["cells"]) for c in flat], np.int64))
            sides = [pa.array([c[k] for c in flat], pa.int32()) for k in ("region", "need")]
            ends = pa.array(np.cumsum([0, *(len(r["cells"]) for r in rows)]), pa.int32())
            columns = []
            for k in range(PASSES):
                own = cells % PASSES == k
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[own], minlength=len(flat)))]), pa.int32()), pa.array(cells[own], pa.int64()))
                columns.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([*sides, lists], ["region", "need", "cells"])).cast(cell_type))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array([r[c] for r in rows], pa.int64()) for c in ("n", "node", "check")), *columns],
                                              names=["id", "n", "node", "check", *_PASS_COLUMNS])

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                ids.append(batch.column(0).slice(i, 1))
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size > BUFFER:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield out(ids, texts)
            if len(seen) > CACHE_WORDS:
                seen.clear()

    return docs.select("id", "text").mapInArrow(run, schema)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (cell, node): the rows of cells with several nodes, once each, and those of the partition's first and last
    cell, which may go on in the next."""
    held, first, prev = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = cell[0] if first is None else first
        again = np.concatenate([[prev is not None and prev == (cell[0], node[0])], (cell[1:] == cell[:-1]) & (node[1:] == node[:-1])])
        prev = cell[-1], node[-1]
        rows = batch.filter(pa.array(~again))
        if not rows.num_rows:
            continue
        table = pa.Table.from_batches([rows] if held is None else [held, rows]).combine_chunks()
        cells = table.column(0).to_numpy()
        before = np.concatenate([[False], cells[1:] == cells[:-1]])
        if held is not None and held_had:
            before[0] = True
        after = np.concatenate([cells[1:] == cells[:-1], [False]])
        keep = (before | after | (cells == first))[:-1]
        if keep.any():
            yield from table.slice(0, len(cells) - 1).filter(pa.array(keep)).to_batches()
        held, held_had = table.slice(len(cells) - 1).to_batches()[0], bool(before[-1])
    if held is not None:
        yield held


def join_sets(sets: list[np.ndarray], order: np.ndarray, percent: int = PERCENT, pivots: int = 8) -> np.ndarray:
    """Component numbers of the sets, by recursion on pivots taken in ``order``."""
    m, eps = len(sets), 1 - percent / 100 + 1e-9
    comp = np.arange(m)
    n = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum([0, *n])[:-1]
    _, ids, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # for every shingle, the sets that hold it
    holders = np.repeat(np.arange(m), n)[np.argsort(ids, kind="stable")]
    first = np.cumsum(uses) - uses
    done = np.zeros(m, bool)
    known: list[np.ndarray] = []
    for p in order:
        others = (comp != comp[p]) & ~done
        for d in known:
            others &= np.abs(d - d[p]) <= eps
        done[p] = True
        if not others.any():
            continue
        own = ids[starts[p] : starts[p] + n[p]]
        ends = np.cumsum(uses[own])
        common = np.bincount(holders[np.repeat(first[own] - ends + uses[own], uses[own]) + np.arange(ends[-1])], minlength=m)
        union = n + n[p] - common
        if len(known) < pivots:
            known.append(1 - common / union)
        linked = 100 * common >= percent * union
        comp[np.isin(comp, comp[linked])] = comp[p]
    return comp


def _region_join(percent: int):  # noqa: ANN202
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, region in rows.groupby("region", sort=False):
            region = region.drop_duplicates("node")
            sets = [np.frombuffer(s, np.uint64) for s in region["shingles"]]
            order = np.lexsort([region["node"].to_numpy(), -region["weight"].to_numpy()])
            comp = join_sets(sets, order, percent)
            node = region["node"].to_numpy()
            out.append(pd.DataFrame({"a": node, "b": node[comp]}))
        return pd.concat(out)

    return run


def _sets(docs: DataFrame, seed: int, width: int) -> DataFrame:
    """From rows (node, region, weight, text): node, region, weight, n, shingles (hashes in order, as bytes). A row whose text has another set is left out (its id is
    used by several rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [(t.as_py() or "").encode() for t in part.column(3)]
                doc, h = shingle_sets(texts, width)
                n = np.bincount(doc, minlength=len(texts))
                node = _pair(_sums(doc, _pair(h, np.uint64(2 * seed + 101)), len(texts)), n.astype(np.uint64)).view(np.int64)
                cut = np.cumsum([0, *n])
                same = pa.array(node == part.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                                                 names=["node", "region", "weight", "n", "shingles"]).filter(same)

    return docs.select("node", "region", "weight", "text").mapInArrow(run, "node long, region long, weight long, n long, shingles binary")


def _peeled(members: DataFrame, percent: int, region_docs: int, region_shingles: int, salts: int = SALTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pivot for each large region: links (a, b) of its core, blocks (region, node, weight, n, shingles) that join the core with the remainder
    in its window, and the remainder as regions."""
    pivot = members.groupBy("region").agg(F.max_by(F.struct("node", "n", "shingles"), F.struct("weight", "node")).alias("p"))
    spread = pivot.select("region", "p", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)])

    joined = salted.join(spread, ["region", "salt"]).select("region", "node", "weight", "n", "shingles", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), common("shingles", "p.shingles").alias("k"))
    joined = written(joined, "jaccard-distances")
    union = F.col("n") + F.col("pn") - F.col("k")
    core = 100 * F.col("k") >= percent * union
    links = joined.where(core).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    rest = joined.where(~core)
    window = rest.where(100 * (union - F.col("k")) <= 2 * (100 - percent) * union)
    blocks = _grid(joined.where(core), window, region_docs, region_shingles)
    return links, blocks, rest.select("region", "node", "weight", "n", "shingles")


def _grid(left: DataFrame, right: DataFrame, region_docs: int, region_shingles: int) -> DataFrame:
    """Blocks of either side against blocks of the other, each pair of blocks a region: of about half the bound of documents and of
    shingles a block."""
    most_docs, most_shingles = max(1, region_docs // 2), max(1, region_shingles // 2)

    def blocks(side: DataFrame) -> DataFrame:
        count = side.groupBy("region").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most_docs), F.ceil(F.sum("n") / most_shingles)).cast("int").alias("blocks"))
        return written(side.select("region", "node", "weight", "n", "shingles").join(count, "region")
                       .withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int")), "jaccard-blocks")

    a, b = blocks(left), blocks(right)
    na, nb = (x.groupBy("region").agg(F.max("blocks").alias("against")) for x in (a, b))

    def paired(side: DataFrame, others: DataFrame, first: bool) -> DataFrame:
        each = side.join(others, "region").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("against") - 1)))
        i, j = ("block", "other") if first else ("other", "block")
        return each.select(F.xxhash64("region", F.lit("grid"), i, j).alias("region"), "node", "weight", "n", "shingles")

    return paired(a, nb, True).unionByName(paired(b, na, False))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, region_docs: int = REGION_DOCS,
                    region_shingles: int = REGION_SHINGLES, seed: int = 0) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    while True:
        with small_batches(spark):
            described, folder = written_at(_described(own, seed, percent, width), "jaccard-sets")
        known = written(described.select("id", "n", "node", "check"), "jaccard-members")
        members = known.where("node IS NOT NULL")
        clash = members.groupBy("node").agg((F.min("check") != F.max("check")).alias("clash")).where("clash")
        if not clash.head(1):
            break
        drop_scratch(spark, folder)
        seed += 1

    # cells that several documents share
    order = ["cell", "node"]
    passes = PASSES if members.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0] > PASS_SHINGLES else 1
    found_cells, cell_folders = [], []
    for k in range(passes):
        cells = described.select("node", F.explode(F.concat(*_PASS_COLUMNS[k::passes])).alias("c")).select("node", "c.region", "c.need", F.explode("c.cells").alias("cell"))
        cells = cells.select("cell", "node", (F.col("region").cast("long") * (1 << 40) + F.col("need")).alias("side"))
        # cells are small rows: they go in batches of Spark's own size
        found, cell_folder = written_at(cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shared, "cell long, node long, side long"), f"jaccard-cells-{k}")
        found_cells.append(found)
        cell_folders.append(cell_folder)
        del cells
        release(spark)
    drop_scratch(spark, folder)
    del described
    shared = functools.reduce(DataFrame.unionByName, found_cells).distinct()
    for step in range(2):
        several = shared.groupBy("cell").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("cell")
        shared = shared.join(several, "cell")
        enough = shared.groupBy("node", "side").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= F.col("side") % (1 << 40)).select("node", "side")
        shared, last_folder = written_at(shared.join(enough, ["node", "side"]), f"jaccard-shared-{step}")
        for cell_folder in cell_folders:
            drop_scratch(spark, cell_folder)
        cell_folders = [last_folder]
        release(spark)
    # a document is a place of its own in each of its size regions, so that families of different sizes don't grow together
    place = F.xxhash64("node", F.shiftright("side", 40))
    leads = shared.groupBy("cell").agg(F.min(place).alias("lead"))
    star = shared.join(leads, "cell").select(F.col("lead").alias("a"), place.alias("b"))
    weights = shared.groupBy("node", place.alias("place")).agg(F.count(F.lit(1)).alias("weight"))
    regions = components(star).select(F.col("node").alias("place"), F.col("comp").alias("region"))
    wanted = weights.join(regions, "place").select("node", "region", "weight")

    # one document of every node, and its set
    picked = members.groupBy("node").agg(F.min("id").alias("pick"))
    wanted = written(wanted.join(picked, "node"), "jaccard-wanted")
    n_wanted = wanted.count()
    fetch = F.broadcast(wanted) if n_wanted <= BROADCAST_IDS else wanted
    with small_batches(spark):
        sets = _sets(own.join(fetch, own["id"].eqNullSafe(F.col("pick"))), seed, width).dropDuplicates(["region", "node"])
        sets = written(sets, "jaccard-regions")

    release(spark)
    links = None
    sizes = sets.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    large = written(sizes.where((F.col("docs") > region_docs) | (F.col("total") > region_shingles)).select("region"), "jaccard-large")
    columns = ["region", "node", "weight", "n", "shingles"]
    tasks, rest = sets.select(columns), None
    if large.head(1):
        tasks, rest = sets.join(large, "region", "left_anti").select(columns), sets.join(large, "region").select(columns)
        for step in range(ROUNDS):
            core, blocks, left = _peeled(rest, percent, region_docs, region_shingles)
            links = core if links is None else links.unionByName(core)
            left = written(left, f"jaccard-rest-{step}")
            grown = left.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
            large = written(grown.where((F.col("docs") > region_docs) | (F.col("total") > region_shingles)).select("region"), f"jaccard-large-{step}")
            tasks = tasks.unionByName(blocks).unionByName(left.join(large, "region", "left_anti").select(columns))
            rest = left.join(large, "region").select(columns)
            if not large.head(1):
                rest = None
                break
        if rest is not None:
            tasks = tasks.unionByName(_grid(rest, rest, region_docs, region_shingles))
    total = tasks.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    buckets = max(1, total // TASK_SHINGLES)
    joined = tasks.groupBy(F.pmod(F.xxhash64("region"), F.lit(buckets)).alias("bucket")).applyInPandas(_region_join(percent), "a long, b long")
    links = joined if links is None else joined.unionByName(links)
    found = components(links)

    named = members.select("id", "n", "node").join(found, "node", "left").select("id", "n", F.coalesce("comp", "node").alias("comp"))
    names = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    blank = known.where("node IS NULL").select("id", "n", F.col("id").alias("component_id"))
    out = named.join(names, "comp").select("id", "n", "component_id").unionByName(blank)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with all their columns: one row of each group (of the smallest id, null ids last; of rows that share it, the one of
    the smallest text hash), and all rows without words. Rows are told apart by id and text, so texts under one id, or under none, are
    documents of their own."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    # a 128-bit hash of the text tells the rows of an id apart
    row = F.struct(docs[id_col].isNull().alias("void"), docs[id_col].alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    found = near_duplicates(docs.select(row.alias("row"), docs[text_col].alias("text")), "row", "text", width, percent)
    found = written(found.select(F.struct("row.id", "row.a", "row.b").alias("row"), (F.col("row") == F.col("component_id")).alias("named"), "n_shingles"), "jaccard-found")
    i, a, b = fresh("id"), fresh("a"), fresh("b")

    def rows(which: DataFrame) -> DataFrame:
        return which.select(F.col("row.id").alias(i), F.col("row.a").alias(a), F.col("row.b").alias(b))

    def same(table: DataFrame, keys: DataFrame) -> Column:
        own = F.coalesce(table[text_col].cast("string"), F.lit(""))
        return table[id_col].eqNullSafe(keys[i]) & (F.xxhash64(own) == keys[a]) & (F.xxhash64(F.lit(1), own) == keys[b])

    gone = written(rows(found.where("NOT named")).distinct(), "jaccard-dropped")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, same(docs, gone), "left_anti")
    several = rows(found.where("named AND n_shingles > 0").groupBy("row").count().where("count > 1"))
    if not several.head(1):
        return kept
    several = written(several, "jaccard-several")  # rows alike in id and text: one of them stays
    once = kept.join(several, same(kept, several)).dropDuplicates([i, a, b]).select(*docs.columns)
    return kept.join(several, same(kept, several), "left_anti").unionByName(once)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""

"""Removal of repeated passages: suffixes in buckets, refined by bucket pointers.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier (in a document with a smaller id, or earlier in
the same document). The suffixes that matter are sorted into buckets by what they begin with, and buckets are refined
by the identifiers of the buckets of later offsets (a 2q-byte bucket is the pair of the q-byte buckets at i and i + q), and only
buckets that still hold different suffixes are refined again:

1. Every window of ``length`` bytes has an anchor: the ``ANCHOR``-byte string in it with the least hash (the leftmost of equals).
   Equal windows have equal anchors at equal places, so that windows need to be compared only within the bucket of their
   anchor. Neighbouring windows with the same anchor form a run, one row. Its identifier is made of the buckets at
   0, 8, 16, 32, 64, ... bytes, up to both ends of the run. Rows are sorted by (anchor, run, document, place) over range partitions, so that
   even a bucket with a third of all rows is spread over many tasks. A run equal to an earlier one goes whole. Buckets with one kind of run are done.
2. What is left are the first rows of each kind in buckets with several kinds. Their bytes are fetched. Sub-buckets by the middle
   bytes common to ``NODE`` neighbouring windows tell those that may share a window; the rest is done.
3. Each sub-bucket refines to single windows; all but the first of equal windows go. Sub-buckets are joined in bounded groups;
   one of more than ``GROUP`` rows is refined by shuffling its windows instead.

Equal means that two 64-bit identifiers over different stretches are equal (128 bits in all).

Defined cases: null texts are empty and lose nothing; null ids come before all others; rows that repeat an id are taken in order
of their texts; texts shorter than ``length`` bytes lose nothing; matches never cross documents; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import release, ship, written

LENGTH = 100
ANCHOR = 32
NODE = 22
GROUP = 4096
#: Documents are hashed together up to so many bytes.
BUFFER = 2_000_000
#: At most so many rows of crowded sub-buckets' keys are broadcast.
BROADCAST_KEYS = 100_000
_PLACE = np.uint64((1 << 24) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Identifier of a pair of bucket identifiers."""
    h = left * _A + right
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


class Buckets:
    """Bucket identifiers of all offsets of a byte buffer, by doubling: 8, 16, ... bytes, up to ``dense``. Those of longer strings are
    made of them only where they are asked for, up to ``longest`` bytes."""

    def __init__(self, data: bytes, longest: int, dense: int = 32):
        raw = np.frombuffer(data + bytes(longest + 8), np.uint8)
        self.n = len(data)
        words = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), shape=(self.n + longest,), strides=(1,)).astype(np.uint64)
        self.by_width, width = {8: _pair(words, np.uint64(8))}, 8
        while 2 * width <= min(dense, longest):
            last = self.by_width[width]
            self.by_width[2 * width] = _pair(last[:-width], last[width:])
            width *= 2

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        """Identifiers of ``width`` (8 or more) bytes at the places: the pair of two buckets that overlap or meet."""
        step = max(w for w in self.by_width if w <= width)
        ids = self.by_width[step]
        if step == width:
            return ids[places]
        if width <= 2 * step:
            return _pair(ids[places], ids[places + (width - step)])
        half = -(-width // 2)
        return _pair(self.at(places, half), self.at(places + (width - half), half))


def runs_of(data: bytes, bounds: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of the documents that lie in ``data`` between ``bounds``: document number, first and last window, place of the anchor
    (all in the buffer), identifiers of the anchor and of the run."""
    n, width = len(data), length - anchor + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    buckets = Buckets(data, length, anchor)
    ids = buckets.by_width[anchor][:n] if anchor in buckets.by_width else buckets.at(np.arange(n), anchor)
    least, wide = (ids & ~_PLACE) | np.arange(n, dtype=np.uint64), 1
    while 2 * wide <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < width:
        least = np.minimum(least[: len(least) - (width - wide)], least[width - wide :])
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    place = np.flatnonzero(np.arange(len(least)) + length <= bounds[doc + 1])
    if not len(place):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = (least[place] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(place) != 1)]))
    lo, hi, at = place[first], place[np.concatenate([first[1:], [len(place)]]) - 1], at[first]
    shape = ((hi - lo) * 256 + (at - lo)).astype(np.uint64)
    run = _pair(_pair(buckets.at(lo, length), buckets.at(hi, length)), shape)
    return doc[lo], lo, hi, at, ids[at], run


def _pieces(rows: Iterator[tuple], length: int) -> Iterator[tuple[list, bytes, np.ndarray]]:
    """Rows (keys, base, bytes) gathered into buffers; a document above a buffer's size is cut into pieces that overlap by
    length - 1 bytes, so that every window lies in exactly one."""
    keys, parts, size = [], [], 0
    for key, data in rows:
        for base in range(0, max(len(data) - length + 1, 1), BUFFER):
            part = data[base : base + BUFFER + length - 1]
            keys.append((*key, base))
            parts.append(part)
            size += len(part)
            if size >= BUFFER:
                yield keys, b"".join(parts), np.cumsum([0, *map(len, parts)])
                keys, parts, size = [], [], 0
    if keys:
        yield keys, b"".join(parts), np.cumsum([0, *map(len, parts)])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_RUN = "anchor long, run long, doc long, dup int, lo int, span int"


def _runs(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """span = 65536 * (anchor's place in the run) + (last window - first window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, dup, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    yield (doc, dup), (text.as_py() or "").encode()

        for keys, data, bounds in _pieces(rows(), length):
            doc, lo, hi, at, a, r = runs_of(data, bounds, length, anchor)
            ids = np.array([k[0] for k in keys], np.int64)
            dups = np.array([k[1] for k in keys], np.int32)
            base = np.array([k[2] for k in keys], np.int64) - bounds[:-1]
            yield pa.RecordBatch.from_arrays(
                [_signed(a), _signed(r), pa.array(ids[doc]), pa.array(dups[doc]), pa.array((lo + base[doc]).astype(np.int32)), pa.array(((at - lo) * 65536 + hi - lo).astype(np.int32))],
                names=["anchor", "run", "doc", "dup", "lo", "span"])

    return texts.mapInArrow(run, _RUN)


def _first_of_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (anchor, run, doc, dup, lo): kind 0, rows whose kind has come before; kind 1, first rows of their kind
    in an anchor's bucket with several kinds; kind 2, first rows in the partition's first or last bucket, which may go on in
    the next partition (``mixed``: another kind is known). First rows of buckets with one kind are done."""
    held = None  # first row of the last kind so far, with whether its bucket had another kind before
    first_anchor = prev = None

    def out(table: pd.DataFrame, kind: np.ndarray, mixed: np.ndarray) -> pa.RecordBatch:
        table = table.assign(kind=kind.astype(np.int8), mixed=mixed)
        return pa.RecordBatch.from_pandas(table[["anchor", "run", "doc", "dup", "lo", "span", "kind", "mixed"]], preserve_index=False)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.to_pandas()
        a, r = rows["anchor"].to_numpy(), rows["run"].to_numpy()
        if first_anchor is None:
            first_anchor = a[0]
        same_bucket = np.concatenate([[prev is not None and prev[0] == a[0]], a[1:] == a[:-1]])
        same_kind = same_bucket & np.concatenate([[prev is not None and prev[1] == r[0]], r[1:] == r[:-1]])
        prev = a[-1], r[-1]
        if same_kind.any():
            gone = rows[same_kind]
            yield out(gone, np.zeros(len(gone)), np.zeros(len(gone), bool))
        starts = rows[~same_kind].assign(had=same_bucket[~same_kind])
        if not len(starts):
            continue
        if held is not None:
            starts = pd.concat([held, starts], ignore_index=True)
        sa, had = starts["anchor"].to_numpy(), starts["had"].to_numpy()
        has = np.concatenate([sa[1:] == sa[:-1], [False]])
        held = starts.iloc[-1:]
        mixed = (had | has)[:-1]
        edge = sa[:-1] == first_anchor
        keep = mixed | edge
        if keep.any():
            yield out(starts.iloc[:-1][keep], np.where(edge, 2, 1)[keep], mixed[keep])
    if held is not None:
        yield out(held, np.full(1, 2), held["had"].to_numpy())


def _contexts(texts: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The rows (first of their kind) with the bytes of their windows."""
    by_doc = rows.groupBy("doc", "dup").agg(F.collect_list(F.struct("anchor", "lo", "span")).alias("rows"))
    joined = texts.join(by_doc, ["doc", "dup"]).select("doc", "dup", "text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, dup, text, found in zip(*(batch.column(i) for i in range(4))):
                data = text.as_py().encode()
                found = found.as_py()
                yield pa.RecordBatch.from_pydict(
                    {"anchor": [x["anchor"] for x in found], "doc": [doc.as_py()] * len(found), "dup": [dup.as_py()] * len(found), "lo": [x["lo"] for x in found], "span": [x["span"] for x in found],
                     "bytes": [data[x["lo"] : x["lo"] + (x["span"] & 65535) + length] for x in found]}, schema=schema)

    schema = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("dup", pa.int32()), ("lo", pa.int32()), ("span", pa.int32()), ("bytes", pa.binary())])
    return joined.mapInArrow(run, "anchor long, doc long, dup int, lo int, span int, bytes binary")


def _nodes(contexts: DataFrame, length: int, anchor: int, node: int, payload: bool) -> DataFrame:
    """A row for every run and node (``node`` neighbouring distances from window to anchor) with windows of the run: core, the identifier of the bytes
    that all windows of the node share, and core2, the anchor's. With ``payload``, also the bytes of those windows of the run."""
    top = length - anchor
    names = ["core", "core2", "doc", "dup", "lo", "dist"] + (["bytes"] if payload else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("bytes").to_pylist()
            if not data:
                continue
            starts = np.cumsum([0, *map(len, data)])[:-1]
            buckets = Buckets(b"".join(data), length)
            span = batch.column("span").to_numpy()
            lead, wide = span >> 16, span & 65535
            lo = batch.column("lo").to_numpy().astype(np.int64)
            a, doc, dup = (batch.column(c).to_numpy() for c in ("anchor", "doc", "dup"))
            for d1 in range(0, top + 1, node):  # distances d1..d2 from a window's start to its anchor
                d2 = min(d1 + node - 1, top)
                near, far = np.maximum(lead - wide, d1), np.minimum(lead, d2)
                i = np.flatnonzero(near <= far)
                if not len(i):
                    continue
                core = _pair(buckets.at(starts[i] + lead[i] - d1, length - (d2 - d1)), np.full(len(i), d1, np.uint64))
                off = (lead - far)[i]
                columns = [_signed(core), pa.array(a[i]), pa.array(doc[i]), pa.array(dup[i]), pa.array((lo[i] + off).astype(np.int32)), pa.array(far[i].astype(np.int32))]
                if payload:
                    columns.append(pa.array([data[k][o : o + (f - e) + length] for k, o, e, f in zip(i.tolist(), off.tolist(), near[i].tolist(), far[i].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return contexts.mapInArrow(run, "core long, core2 long, doc long, dup int, lo int, dist int" + (", bytes binary" if payload else ""))


def _windows(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Every window of the rows: row number, core, core2, dist, id, doc, dup, place."""
    data = rows["bytes"].tolist()
    sizes = np.array([len(x) for x in data])
    starts = np.cumsum([0, *sizes])[:-1]
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(data)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum([0, *counts])[:-1], counts)
    ids = Buckets(b"".join(data), length).at(starts[row] + step, length).view(np.int64)
    take = lambda c: rows[c].to_numpy()[row]
    return pd.DataFrame({"row": row, "core": take("core"), "core2": take("core2"), "dist": take("dist") - step, "id": ids,
                         "doc": take("doc"), "dup": take("dup"), "place": take("lo") + step})


_SPANS = "doc long, dup int, lo int, hi int"


def _equal_windows(length: int):  # noqa: ANN202
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        w = _windows(rows, length)
        order = np.lexsort([w[c].to_numpy() for c in ("place", "dup", "doc", "id", "dist", "core2", "core")])
        key = w[["core", "core2", "dist", "id"]].to_numpy()[order]
        again = np.concatenate([[False], (key[1:] == key[:-1]).all(axis=1)])
        gone = w.iloc[np.sort(order[again])]
        if not len(gone):
            return pd.DataFrame({"doc": pd.Series(dtype="int64"), "dup": pd.Series(dtype="int32"), "lo": pd.Series(dtype="int32"), "hi": pd.Series(dtype="int32")})
        row, place = gone["row"].to_numpy(), gone["place"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]))
        ends = np.concatenate([cut[1:], [len(row)]]) - 1
        return pd.DataFrame({"doc": gone["doc"].to_numpy()[cut], "dup": gone["dup"].to_numpy()[cut].astype(np.int32), "lo": place[cut].astype(np.int32), "hi": place[ends].astype(np.int32)})

    return run


def _exploded_windows(rows: DataFrame, length: int) -> DataFrame:
    """Spans of windows equal to an earlier one, by shuffling single windows: for crowded sub-buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _windows(batch, length).drop(columns="row")

    single = rows.mapInPandas(run, "core long, core2 long, dist long, id long, doc long, dup int, place long")
    key = ["core", "core2", "dist", "id"]
    firsts = single.groupBy(*key).agg(F.min(F.struct("doc", "dup", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return (single.join(firsts, key).where(F.struct("doc", "dup", "place") > F.col("first"))
            .select("doc", "dup", F.col("place").cast("int").alias("lo"), F.col("place").cast("int").alias("hi")))


def repeated_spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, node: int = NODE, group: int = GROUP) -> DataFrame:
    """From rows (doc, dup, text): doc, dup and (lo, hi), the first and last start of windows that also start earlier."""
    spark = texts.sparkSession
    ship(spark)
    order = ["anchor", "run", "doc", "dup", "lo"]
    sorted_runs = _runs(texts, length, anchor).repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(sorted_runs.mapInArrow(_first_of_kind, _RUN + ", kind byte, mixed boolean"), "suffix-runs")
    del sorted_runs
    release(spark)
    span = lambda rows: rows.select("doc", "dup", "lo", (F.col("lo") + F.col("span").bitwiseAND(65535)).cast("int").alias("hi"))
    again = span(found.where("kind = 0"))

    # buckets that lie across partitions
    edge = found.where("kind = 2")
    kinds = edge.groupBy("anchor", "run").agg(F.min(F.struct("doc", "dup", "lo", "span")).alias("f"), F.max("mixed").alias("mixed"))
    several = kinds.groupBy("anchor").agg((F.max("mixed") | (F.count(F.lit(1)) > 1)).alias("several")).where("several")
    edge_again = span(edge.join(kinds.select("anchor", "run", "f"), ["anchor", "run"]).where(F.struct("doc", "dup", "lo") > F.struct("f.doc", "f.dup", "f.lo")))
    first = found.where("kind = 1").select("anchor", "doc", "dup", "lo", "span")
    first = first.unionByName(kinds.join(several, "anchor").select("anchor", "f.doc", "f.dup", "f.lo", "f.span"))

    contexts = written(_contexts(texts, first, length), "suffix-contexts")
    release(spark)
    cores = _nodes(contexts, length, anchor, node, payload=False).groupBy("core", "core2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cores = written(cores, "suffix-cores")
    crowded = cores.where(F.col("n") > group).select("core", "core2")
    n_crowded, n_rows = crowded.count(), cores.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    rows = _nodes(contexts, length, anchor, node, payload=True)
    buckets = max(1, n_rows // group)
    shared = rows.join(cores.where(F.col("n") <= group).select("core", "core2"), ["core", "core2"], "left_semi")
    joined = shared.groupBy(F.pmod(F.xxhash64("core", "core2"), F.lit(buckets)).alias("b")).applyInPandas(_equal_windows(length), _SPANS)
    out = again.unionByName(edge_again).unionByName(joined)
    if n_crowded:
        hot = F.broadcast(crowded) if n_crowded <= BROADCAST_KEYS else crowded
        out = out.unionByName(_exploded_windows(rows.join(hot, ["core", "core2"], "left_semi"), length))
    return written(out, "suffix-spans")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc (a number that orders like the id), dup (number among rows of the same id, in order of texts), text. Integers are their own numbers (null
    before any); rows of other ids are sorted by (id, text) once and numbered in that order, null ids first."""
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    if not isinstance(own.schema["id"].dataType, T.IntegralType):
        # ranges of ids go to tasks in order, and the number counts up within a task: written, so that no rerun numbers anew
        listed = own.repartitionByRange("id", "text").sortWithinPartitions("id", "text")
        return written(listed.select("id", F.monotonically_increasing_id().alias("doc"), F.lit(0).alias("dup"), "text"), "suffix-rows")
    own = own.select("id", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))).alias("doc"), "text")
    repeated = own.groupBy("doc").count().where("count > 1").head(1)
    if not repeated:
        return own.withColumn("dup", F.lit(0))
    return own.withColumn("dup", F.row_number().over(Window.partitionBy("doc").orderBy(F.col("text").asc_nulls_first())) - 1)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = True,
                    anchor: int = ANCHOR, node: int = NODE, group: int = GROUP) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with ``keep_text``, kept (binary)."""
    keyed = _keyed(docs, id_col, text_col)
    texts = keyed.select("doc", "dup", "text")
    spans = repeated_spans(texts, length, anchor, node, group)
    release(docs.sparkSession)
    by_doc = spans.groupBy("doc", "dup").agg(F.collect_list((F.col("lo").cast("long") * (1 << 31) + F.col("hi"))).alias("spans"))
    joined = keyed.join(by_doc, ["doc", "dup"], "left").select("id", "text", "spans")
    id_type = joined.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, sums, kept = [], [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                found = np.sort(spans.values.to_numpy()) if spans.is_valid else np.zeros(0, np.int64)
                parts, at, gone, count = [], 0, 0, 0
                if len(found):
                    lo, hi = found >> 31, (found & ((1 << 31) - 1)) + length
                    reach = np.maximum.accumulate(hi)
                    cut = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
                    count = len(cut)
                    for a, b in zip(lo[cut].tolist(), reach[np.concatenate([cut[1:], [len(lo)]]) - 1].tolist()):
                        parts.append(data[at:a])
                        gone += b - a
                        at = b
                parts.append(data[at:])
                rest = b"".join(parts)
                n_bytes.append(len(data))
                n_removed.append(gone)
                n_spans.append(count)
                sums.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sums, pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))

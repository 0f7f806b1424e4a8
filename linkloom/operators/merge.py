"""Upsert (S5, S7, J8), insert-or-ignore (S6, J7) and keyed lookup with default.

A merge brings a (usually small) slice into a (usually large) table. The table is never aggregated or
shuffled for it: it streams once through a join with the slice's keys, which are broadcast when the slice
is provably small (size-checked), and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import DEFAULT_BROADCAST_ROWS, broadcast_if_small


def latest_per_key(source: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """One row per key, with all columns: the one with the largest ``order_col``; a row without order is older than any
    other. ``max_by`` is a partial aggregate, so a key repeated many times is combined map-side. The order is compared
    inside a struct, because a bare NULL order would be skipped and leave a row of NULLs."""
    rest = [c for c in source.columns if c not in keys]
    picked = source.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order_col)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order_col: str,
           max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Insert or overwrite all non-key columns: a source row replaces the target row with its key. Among several
    source rows for one key the last writer wins, the one with the largest ``order_col``. The order is a column of the
    source; it stays in the result if the target has it, too."""
    fresh = latest_per_key(source, keys, order_col).select(*target.columns)
    replaced = broadcast_if_small(fresh.select(*keys), max_broadcast_rows)
    return target.join(replaced, keys, "left_anti").select(*target.columns).unionByName(fresh)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order_col: str,
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Existing keys win; only new keys from ``source`` are added, once: of several source rows for one key the first
    writer wins, the one with the least ``order_col`` (a row without order comes before any other)."""
    rest = [c for c in source.columns if c not in keys]
    first = source.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order_col)).alias("_row"))
    incoming = first.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*target.columns)
    probe = broadcast_if_small(incoming.select(*keys), max_broadcast_rows)
    existing = target.select(*keys).join(probe, keys, "left_semi")        # the table streams past the keys
    return target.unionByName(incoming.join(existing, keys, "left_anti"))


def lookup_with_default(table: DataFrame, probes: DataFrame, keys: list[str], value_col: str, default: str
                        ) -> DataFrame:
    """Value for each probe key, ``default`` when the key has no row."""
    return (probes.select(*keys).join(table.select(*keys, value_col), keys, "left")
            .select(*keys, F.coalesce(F.col(value_col), F.lit(default)).alias(value_col),
                    F.col(value_col).isNull().alias("is_default")))

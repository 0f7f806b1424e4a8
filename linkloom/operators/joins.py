"""Join helpers: broadcast only behind a checked size bound, with the shuffle join as the other way."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Hint ``broadcast`` only when ``df`` provably has at most ``max_rows`` rows.

    The side is persisted (memory, spilling to disk; recomputed from lineage if an executor is lost) and
    counted, so the check and the join share one computation. Above the bound the persisted DataFrame is
    returned without the hint and the planner (with AQE) chooses a shuffle join.
    """
    if max_rows <= 0:
        return df
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    n = kept.count()
    return F.broadcast(kept) if n <= max_rows else kept

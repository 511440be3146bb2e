"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side with at most this many rows and bytes (as cached) is broadcast; beyond either the join stays a shuffle join
# (sort-merge with AQE skew splitting).
BROADCAST_ROW_LIMIT, BROADCAST_BYTE_LIMIT = 2_000_000, 64 << 20


def cached_bytes(df: DataFrame) -> int:
    """Size of a persisted, materialised table as Spark's cache measured it."""
    return int(df.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Join a side that is expected to be small (per-group statistics, calendars, lookups).

    The small side is materialised once and measured; it is broadcast only when its rows are within ``max_rows``
    and its bytes within the byte limit — checked bounds, not estimates — so the big side is never shuffled for it.
    Otherwise the regular shuffle join is kept."""
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    n = small.count()
    return big.join(F.broadcast(small) if n <= max_rows and cached_bytes(small) <= BROADCAST_BYTE_LIMIT else small, on, how)

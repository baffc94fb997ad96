"""Helpers of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast.
SMALL_ROWS = 100_000


def checked_broadcast(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df

"""Join sides: broadcast where a count shows that a side is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has up to BROADCAST_ROWS rows; else Spark picks a shuffle join.

    Only BROADCAST_ROWS + 1 rows are looked at to tell."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df

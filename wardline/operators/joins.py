"""Joins with a side that may be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 250_000


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a count; a larger side joins by shuffle, and so does a stream."""
    return F.broadcast(df) if not df.isStreaming and df.limit(limit + 1).count() <= limit else df


#: Rows of a table that each batch of a stream may broadcast anew.
BATCH_ROWS = 10_000


def joined_by_batches(df: DataFrame, limit: int = BATCH_ROWS) -> DataFrame:
    """A table that every batch of a stream joins, and so collects at the driver again where it is broadcast: that only up to
    ``limit`` rows by count, else by shuffle, however few bytes Spark takes it to have."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")

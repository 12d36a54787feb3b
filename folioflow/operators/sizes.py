"""Sides of joins that are sent to all executors only after a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers or words that fit every executor with room to spare.
ROWS = 200_000


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``rows`` rows, else as it is, for a shuffled join.

    The check counts up to one row more than that; the result of a join is the same either way.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

"""Join helpers: broadcast only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side we are willing to ship to every executor, in rows. Dimension and
# rule tables are far below this; anything above takes a shuffle join instead.
DEFAULT_MAX_BROADCAST_ROWS = 200_000


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    ``limit(max_rows + 1).count()`` stops scanning as soon as the bound is
    exceeded, so the check costs at most max_rows + 1 rows, never a full scan of
    a large table.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Return ``(df with a broadcast hint, True)`` if it is provably small.

    Otherwise ``(df, False)``: the caller's join is planned by Catalyst/AQE as a
    shuffle join (with AQE skew splitting), which scales with the data.
    """
    if row_count_at_most(df, max_rows):
        return F.broadcast(df), True
    return df, False

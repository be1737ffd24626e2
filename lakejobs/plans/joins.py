"""Join helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it has at most this many rows. Callers pass a
# tighter bound when rows are wide (vectors).
DEFAULT_MAX_BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Return (df, broadcast?) after counting at most ``max_rows + 1`` rows.

    The count reads only as far as needed (``limit``), so the check is cheap
    for small sides and bounded for large ones. Beyond the bound the side is
    returned unchanged and the join falls back to a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False

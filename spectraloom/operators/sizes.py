"""Broadcasts behind a count."""

from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def counted_side(small, limit=BROADCAST_ROWS):
    """`small` with a broadcast hint if it has at most `limit` (narrow) rows.

    For fetching vectors by key: without the hint both sides would be shuffled before
    adaptive execution sees that one of them is tiny. Hand in a frozen or cheap table.
    """
    few = small.limit(limit + 1).count() <= limit
    return F.broadcast(small) if few else small

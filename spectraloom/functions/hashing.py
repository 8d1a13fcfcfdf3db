"""Seeded pseudo-random columns that do not depend on partitioning.

They come from MD5 of a text, which other engines have too, so that SQL can repeat every draw.
"""

from pyspark.sql import functions as F


def _hex(keys, salt, digits):
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys], *[F.lit(str(s)) for s in salt])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def seeded_hash(keys, seed):
    """60 bits from the key columns and a seed."""
    return _hex(keys, [int(seed)], 15)


def uniform(keys, seed, stream):
    """A uniform in [0, 1) derived from the key columns, a seed and a stream name; 52 bits."""
    return _hex(keys, [int(seed), stream], 13) / F.lit(float(1 << 52))


def integer_below(u, n):
    """Map a uniform to 0 .. n-1."""
    n = n if not isinstance(n, (int, float)) else F.lit(n)
    return F.least(F.floor(u * n), n - 1).cast("int")

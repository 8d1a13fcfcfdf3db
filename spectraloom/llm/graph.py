"""Connected components of a table of links, by alternating stars.

Every round joins each node's neighbours to the smallest one it knows; the links become stars around
the smallest node of each component. Rounds are written to the shared folder, which cuts their lineage.
A node with very many links is a key of a join that adaptive execution splits; minima are taken
before rows are shuffled.
"""

from pyspark.sql import functions as F

from spectraloom.session import handed_over


def _stars(links, larger_only):
    """Link neighbours of u to the smallest of u and its neighbours: the larger ones, or all smaller ones and u."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    if larger_only:
        least = least.select("u", F.least("u", "m").alias("m"))
        joined = links.join(least, "u")
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    joined = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v")))


def _state(links):
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(links):
    """(node, component): the smallest node of each linked node's component. `links` has long u and v.

    Links to oneself and repeated links change nothing; NULLs are dropped; no links, no rows.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = handed_over(links, "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, True).filter("u <> v").distinct()
        links = handed_over(_stars(large, False).filter("u <> v").distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    ends = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)

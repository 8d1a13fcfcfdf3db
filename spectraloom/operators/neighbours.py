"""Exact k nearest partners in (z, snr) within a class.

Candidates are packed into blocks along a space-filling curve and blocks into nodes, each
with a bounding box. A query starts with the few top nodes of its class and goes down level
by level; a node is dropped when its box is farther away than a distance within which enough
partners are already known to lie. Every join is an equi-join on a node, no step emits all
pairs, and nothing is cut off without proof:

* blocks hold a fixed number of candidates, whatever the density;
* of the candidates at one point only those that can still rank among the first k are kept:
  the first k of each object, and of those the first 2k;
* nodes carry bounds on how many of their rows one object can have, so that excluding the
  query's own object stays exact when one object holds a large share of a class.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import freeze
from .ordering import positions_and_count

BLOCK = 64
FANOUT = 8
# node tables of at most this many rows (counted, about 100 bytes each) are broadcast; larger ones are shuffled
BROADCAST_NODES = 100_000
CODE_BITS = 24
CODE_RANGE_SIGMAS = 8.0

QUERY = ["q_class", "q_z", "q_snr", "q_obj"]
# Identity of a query as text, led in sorts by its hash, which settles nearly every
# comparison. Doubles as window keys would be normalised by Spark and no longer match the
# partitioning of the queries, so that every level would shuffle again.
KEY = ["q_hash", "q_text"]
CARRIED = [*KEY, *QUERY]


def split_spread(df):
    """Sample standard deviations of z and snr over the whole table, plus a small constant."""
    return df.agg(
        (F.stddev_samp("z") + 1e-8).alias("z_std"),
        (F.stddev_samp("snr") + 1e-8).alias("snr_std"),
        F.avg("z").alias("z_mean"),
        F.avg("snr").alias("snr_mean"),
    )


def _spread_bits(x):
    """Put zero bits between the low 24 bits of an integer column."""
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _curve_code(z, snr, spread):
    """Z-order code of the standardised point; only locality depends on it, not results."""
    top = float((1 << CODE_BITS) - 1)

    def cell(value, mean, std):
        scaled = ((value - F.lit(mean)) / F.lit(std) + CODE_RANGE_SIGMAS) / (2 * CODE_RANGE_SIGMAS)
        return F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * top).cast("bigint")

    x = _spread_bits(cell(z, spread["z_mean"], spread["z_std"]))
    y = _spread_bits(cell(snr, spread["snr_mean"], spread["snr_std"]))
    return x.bitwiseOR(F.shiftleft(y, 1))


def _trim_points(rows, k):
    """Per point the first k rows of each object, and of these the first 2k."""
    by_object = W.partitionBy("cls", "z", "snr", "obj").orderBy("row_idx")
    by_point = W.partitionBy("cls", "z", "snr").orderBy("row_idx")
    # limits on row_number are also applied before the shuffle
    first = rows.withColumn("__n", F.row_number().over(by_object)).filter(F.col("__n") <= k)
    second = first.withColumn("__m", F.row_number().over(by_point)).filter(F.col("__m") <= 2 * k)
    return second.drop("__n", "__m")


def _together(nodes, key):
    """Bring the parts of a node to one partition, so that grouping them shuffles once."""
    return nodes.repartition("cls", key)


def _leaf_nodes(blocks):
    """Box, row count, commonest object and bounds for it and for all others, per block."""
    per_object = blocks.groupBy("cls", "node", "obj").agg(
        F.count("*").alias("n"),
        F.min("z").alias("z_lo"),
        F.max("z").alias("z_hi"),
        F.min("snr").alias("s_lo"),
        F.max("snr").alias("s_hi"),
    )
    return _summarise(per_object.withColumns({"extra": F.col("n"), "base": F.lit(0)}), "node")


def _parent_nodes(nodes):
    per_object = _together(nodes, "parent").groupBy("cls", "parent", "obj").agg(
        F.sum("n").alias("n"),
        F.min("z_lo").alias("z_lo"),
        F.max("z_hi").alias("z_hi"),
        F.min("s_lo").alias("s_lo"),
        F.max("s_hi").alias("s_hi"),
        F.sum("others").alias("base"),
        F.sum(F.col("most") - F.col("others")).alias("extra"),
    )
    return _summarise(per_object, "parent")


def _summarise(parts, node):
    """Combine parts (one per object and node) into one row per node.

    An object has at most sum(base) rows in the node, plus its own `extra`.
    """
    ranked = parts.groupBy("cls", F.col(node).alias("node")).agg(
        F.min("z_lo").alias("z_lo"),
        F.max("z_hi").alias("z_hi"),
        F.min("s_lo").alias("s_lo"),
        F.max("s_hi").alias("s_hi"),
        F.sum("n").alias("n"),
        F.sum("base").alias("base"),
        # at most BLOCK or FANOUT entries
        F.sort_array(F.collect_list(F.struct("extra", "obj")), False).alias("top"),
    )
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    return ranked.select(
        "cls",
        "node",
        F.floor(F.col("node") / FANOUT).cast("bigint").alias("parent"),
        "z_lo",
        "z_hi",
        "s_lo",
        "s_hi",
        "n",
        first["obj"].alias("obj"),
        (F.col("base") + first["extra"]).alias("most"),
        (F.col("base") + F.coalesce(second["extra"], F.lit(0))).alias("others"),
    )


def _bounded(df, rows):
    """Broadcast a table whose counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_NODES else df


def _prune(frontier, spread, k):
    """Drop nodes that cannot hold one of the k nearest partners of their query."""
    z_std, s_std = F.lit(spread["z_std"]), F.lit(spread["snr_std"])

    def square(x):
        return x * x

    def near(q, low, high, std):
        return square(F.greatest(F.col(low) - F.col(q), F.col(q) - F.col(high), F.lit(0.0)) / std)

    def far(q, low, high, std):
        return square(F.greatest(F.abs(F.col(low) - F.col(q)), F.abs(F.col(high) - F.col(q))) / std)

    own = F.col("obj").eqNullSafe(F.col("q_obj"))
    only_own = own & (F.col("others") == 0)
    least = F.greatest(F.col("n") - F.when(own, F.col("most")).otherwise(F.least("others", "n")), F.lit(0))
    measured = frontier.filter(~only_own).select(
        *CARRIED,
        "node",
        "reach",
        (near("q_z", "z_lo", "z_hi", z_std) + near("q_snr", "s_lo", "s_hi", s_std)).alias("nearest"),
        (far("q_z", "z_lo", "z_hi", z_std) + far("q_snr", "s_lo", "s_hi", s_std)).alias("farthest"),
        least.alias("sure"),
    )
    # the level above already bounds the distance, so few nodes are sorted
    close = measured.filter("nearest <= reach")
    by_distance = W.partitionBy(*KEY).orderBy("farthest").rowsBetween(W.unboundedPreceding, 0)
    counted = close.withColumn("known", F.sum("sure").over(by_distance))
    proved = F.min(F.when(F.col("known") >= k, F.col("farthest"))).over(W.partitionBy(*KEY))
    reach = F.least("reach", F.coalesce(proved, F.col("reach")))
    return counted.withColumn("reach", reach).filter("nearest <= reach").select(*CARRIED, "node", "reach")


@dataclass(frozen=True)
class PartnerIndex:
    """Node tables over a set of candidates, frozen, for searches of up to `k` partners."""

    k: int
    spread: dict
    total: int
    widths: list
    levels: list
    packed: DataFrame


def build_index(candidates, k, spread=None):
    """Index `candidates` once for many searches; see `nearest_partners` for the arguments."""
    usable = candidates.filter("z is not null and snr is not null and not isnan(z) and not isnan(snr)")
    # a row without an object name is an object of its own
    name = F.coalesce(F.col("obj").cast("string"), F.concat(F.lit("#"), F.col("row_idx")))
    usable = usable.select("cls", "z", "snr", name.alias("obj"), "row_idx")
    if spread is None:
        spread = split_spread(usable).first().asDict()
    spread = {name: value if value is not None else 1e-8 for name, value in spread.items()}

    points = _trim_points(usable, k).withColumn("code", _curve_code(F.col("z"), F.col("snr"), spread))
    placed, total = positions_and_count(points, "cls", "code", "z", "snr", "row_idx", name="place")
    blocks = placed.withColumn("node", F.floor(F.col("place") / BLOCK).cast("bigint"))
    blocks = _together(blocks, "node")

    # two classes may share a block, hence one more row per class and level
    widths = [-(-total // BLOCK)]
    levels = [freeze(_leaf_nodes(blocks))]  # every level above is built from these
    while widths[-1] > FANOUT:
        levels.append(_parent_nodes(levels[-1]))
        widths.append(-(-widths[-1] // FANOUT))
    packed = blocks.groupBy(F.col("cls").alias("q_class"), "node").agg(
        F.collect_list(F.struct("z", "snr", "obj", "row_idx")).alias("rows")  # at most BLOCK
    )
    return PartnerIndex(k, spread, total, widths, [levels[0], *map(freeze, levels[1:])], freeze(packed))


def nearest_partners(queries, candidates, k, spread=None):
    """The k nearest candidates per query, ordered by (distance, row_idx).

    `queries`: q_class (class to search), q_z, q_snr, q_obj (object to leave out).
    `candidates`: cls, z, snr, obj, row_idx (unique). Rows without z or snr are ignored.
    `spread`: standard deviations that scale the axes, from `split_spread`.
    Result: the query columns, rank from 1, row_idx and dist.
    """
    return search(build_index(candidates, k, spread), queries, k)


def search(index, queries, k):
    """The k nearest partners of each query, as `nearest_partners` gives them; k is at most the index's."""
    if k > index.k:
        raise ValueError(f"the index serves up to {index.k} partners, asked for {k}")
    spread, levels, widths = index.spread, index.levels, index.widths
    # adding 0.0 makes one number of both zeros
    numbers = [(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in ("q_z", "q_snr")]
    asked = queries.select("q_class", *numbers, F.col("q_obj").cast("string").alias("q_obj"))
    asked = asked.filter("q_z is not null and q_snr is not null").distinct()
    asked = asked.withColumn("q_text", F.concat_ws("|", *QUERY))
    asked = asked.withColumns({"q_hash": F.xxhash64("q_text"), "reach": F.lit(float("inf"))})
    # a query grows to some hundred rows on its way down, so the small table is spread out
    # by an explicit number, which adaptive execution leaves alone; the windows need no other shuffle
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(tasks, "q_hash")
    top = F.broadcast(levels[-1].withColumnRenamed("cls", "q_class"))  # about FANOUT rows
    frontier = _prune(asked.join(top, "q_class"), spread, k)
    for nodes, width in zip(reversed(levels[:-1]), reversed(widths[:-1])):
        below = nodes.withColumnRenamed("cls", "q_class").withColumnRenamed("node", "child")
        step = frontier.withColumnRenamed("node", "parent").join(
            _bounded(below, width), ["q_class", "parent"]
        )
        frontier = _prune(step.withColumnRenamed("child", "node"), spread, k)

    pairs = frontier.join(_bounded(index.packed, index.total), ["q_class", "node"]).select(*CARRIED, "reach", F.inline("rows"))
    dz = (F.col("z") - F.col("q_z")) / F.lit(spread["z_std"])
    dsnr = (F.col("snr") - F.col("q_snr")) / F.lit(spread["snr_std"])
    measured = pairs.withColumn("dist", dz * dz + dsnr * dsnr).filter(
        (F.col("dist") <= F.col("reach")) & ~F.col("obj").eqNullSafe(F.col("q_obj"))
    )
    order = W.partitionBy(*KEY).orderBy("dist", "row_idx")
    ranked = measured.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(*QUERY, "rank", "row_idx", "dist")

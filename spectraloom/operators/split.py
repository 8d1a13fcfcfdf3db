"""Seeded, partition-independent splits, shuffles and per-class samples."""

from pyspark.sql import Window as W, functions as F

from ..functions.hashing import seeded_hash
from ..session import handed_over
from ..settings import EPS
from .ordering import with_positions
from .sizes import counted_side

#: a hash's leading 16 bits number its bucket
BUCKET_SHIFT = 60 - 16


def _cut_places(df, by, keys, seed, quotas):
    """Per class a map from name to the (hash, key) of the row where the quota is reached.

    `quotas` maps a name to a column over the class size `__total`. Only a histogram of the
    hashes and the rows of the few buckets with a cut are shuffled, so classes of any size
    and any imbalance cost two light passes. Rows without a class form a class of their own.
    The places are stored once; a table has a row per class.
    """
    marked = df.select(by, seeded_hash(keys, seed).alias("__h"), F.struct(*keys).alias("__k")).withColumn(
        "__b", F.shiftright("__h", BUCKET_SHIFT)
    )
    sizes = marked.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    # at most 2^16 rows per class
    order = W.partitionBy(by).orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    running = sizes.withColumn("__upto", F.sum("__n").over(order)).withColumn(
        "__total", F.sum("__n").over(W.partitionBy(by))
    )
    wanted = [F.struct(F.lit(n).alias("name"), q.cast("bigint").alias("quota")) for n, q in quotas.items()]
    cuts = running.select(by, "__b", "__n", "__upto", F.explode(F.array(*wanted)).alias("__cut"))
    before = F.col("__upto") - F.col("__n")
    cuts = cuts.filter((F.col("__cut.quota") > before) & (F.col("__cut.quota") <= F.col("__upto"))).select(
        by, "__b", F.col("__cut.name").alias("__name"), (F.col("__cut.quota") - before).alias("__place")
    )
    # one row per class and name
    cuts = counted_side(handed_over(cuts.withColumnsRenamed({by: "__class", "__b": "__bucket"}), "cuts"))
    in_bucket = W.partitionBy("__class", "__b", "__name").orderBy("__h", "__k")
    last = (
        marked.join(cuts, F.col(by).eqNullSafe(F.col("__class")) & (F.col("__b") == F.col("__bucket")))
        .withColumn("__r", F.row_number().over(in_bucket))
        .filter(F.col("__r") == F.col("__place"))
        .groupBy("__class")
        .agg(F.map_from_entries(F.collect_list(F.struct("__name", F.struct("__h", "__k")))).alias("__last"))
    )
    return handed_over(last, "places")


def _with_cuts(df, by, keys, seed, quotas):
    """`df` with the cut places of its class (one row per class, counted before it is broadcast)."""
    place = F.struct(seeded_hash(keys, seed).alias("__h"), F.struct(*keys).alias("__k"))
    places = counted_side(_cut_places(df, by, keys, seed, quotas))
    return df.join(places, F.col(by).eqNullSafe(F.col("__class")), "left"), place


def stratified_split(df, by, keys, seed=42, shares=(("train", 0.70), ("val", 0.15), ("test", 0.15))):
    """Add `split` with exact quotas per class; `keys` must identify a row.

    Rows are ordered by a seeded hash and cut where a class's quota is reached. Rows without a
    class are split like a class of their own.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    quotas, so_far = {}, 0.0
    for name, share in shares[:-1]:
        so_far += share
        quotas[name] = F.round(F.col("__total") * F.lit(so_far))
    cut, place = _with_cuts(df, by, keys, seed, quotas)
    label = F
    for name in quotas:
        label = label.when(place <= F.col("__last")[name], name)
    return cut.withColumn("split", label.otherwise(shares[-1][0])).select(*df.columns, "split")


def seeded_shuffle(df, keys, seed, position=None):
    """Order rows by a seeded hash, for when an order is consumed.

    With `position`, the 0-based place of each row is added in a column of that name instead.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if position is None:
        return df.orderBy(seeded_hash(keys, seed), *keys)
    placed = with_positions(df.withColumn("__h", seeded_hash(keys, seed)), "__h", *keys, name=position)
    return placed.drop("__h")


def first_per_class(df, by, keys, n=50, seed=42, only=None):
    """n rows per class after a seeded shuffle, optionally of rows meeting a condition."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    chosen = df if only is None else df.filter(only)
    cut, place = _with_cuts(chosen, by, keys, seed, {"first": F.least(F.lit(n), F.col("__total"))})
    return cut.filter(place <= F.col("__last")["first"]).select(*df.columns)


def scaled_redshift(df, z_col="z", eps=EPS, name="z_scaled"):
    """Redshift standardised over the whole table with the population std."""
    stats = df.select(
        F.struct(F.avg(z_col).alias("mean"), F.stddev_pop(z_col).alias("std")).alias("s")
    ).scalar()
    return df.withColumn(name, (F.col(z_col) - stats["mean"]) / (stats["std"] + F.lit(eps)))


def class_weight(df, target="label", where=None):
    """Negatives per positive."""
    chosen = df if where is None else df.filter(where)
    negatives = F.sum((F.col(target) == 0).cast("bigint"))
    positives = F.sum((F.col(target) == 1).cast("bigint"))
    return chosen.agg(F.try_divide(negatives.cast("double"), positives).alias("pos_weight"))

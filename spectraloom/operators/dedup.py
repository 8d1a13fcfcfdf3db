"""Order-dependent de-duplication by aggregates with map-side combine.

A window would bring all copies of a key to one task; an aggregate keeps one row per key
and map task, so a key holding a large share of the table does no harm. Tables of scalars
carry the whole row through the aggregate. Where a row has vectors, the aggregate sees keys
and order only, and the rows are fetched by the winning order afterwards: few winners are counted
and broadcast, so that vectors are filtered where they are read. For many winners, a table bucketed by
the key (`session.handed_over`) keeps its vectors in place too (`colocated`).
"""

from pyspark.sql import Window as W, functions as F, types as T

from ..session import handed_over
from .sizes import counted_side


def _one_per_key(df, keys, order, first=True):
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    order = F.struct(*order)
    if not any(isinstance(f.dataType, (T.ArrayType, T.MapType)) for f in df.schema):
        pick = F.min_by if first else F.max_by
        chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__row"))
        return chosen.select(*keys, "__row.*").select(*df.columns)
    best = (F.min if first else F.max)("__order").alias("__best")
    ordered = df.withColumn("__order", order)
    winners = ordered.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(best)
    winners = counted_side(handed_over(winners, "winners"))
    same = F.col("__order").eqNullSafe(F.col("__best"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    # one row is left, or a few that tie
    ties = W.partitionBy(*keys).orderBy("__order")
    numbered = ordered.join(winners, same).withColumn("__n", F.row_number().over(ties))
    return numbered.filter("__n = 1").select(*df.columns)


def _one_per_bucket_key(df, key, order, first=True):
    """As `_one_per_key` for a table bucketed by `key`: no row leaves its bucket.

    The join has the bucket column as its only key; the winning order is compared beyond it.
    """
    some = df.filter(F.col(key).isNotNull()).withColumn("__order", F.struct(*order))
    best = (F.min if first else F.max)("__order").alias("__best")
    met = some.join(some.groupBy(key).agg(best), key)
    met = met.filter(F.col("__order") <= F.col("__best") if first else F.col("__order") >= F.col("__best"))
    ties = W.partitionBy(key).orderBy("__order")
    found = met.withColumn("__n", F.row_number().over(ties)).filter("__n = 1").select(*df.columns)
    return found.unionByName(_one_per_key(df.filter(F.col(key).isNull()), key, order, first))


def keep_first(df, keys, order):
    """The row with the smallest `order` (a unique column or list of them) per key."""
    return _one_per_key(df, keys, [order] if isinstance(order, str) else list(order))


def keep_last(df, keys, order):
    return _one_per_key(df, keys, [order] if isinstance(order, str) else list(order), first=False)


def best_by_snr(df, key="obj_id", snr="snr", tie="filename", colocated=False):
    """Highest-SNR row per object; missing SNR ranks last, ties go to the smallest `tie`.

    `colocated` says that `df` is a table bucketed by `key`.
    """
    ties = [tie] if isinstance(tie, str) else list(tie)
    value = F.col(snr)
    missing = value.isNull() | F.isnan(value)
    pick = _one_per_bucket_key if colocated else _one_per_key
    return pick(df, key, [missing.alias("m"), (-value).alias("v"), *ties])


def brightest_per_class(df, by="agn_type", snr="snr", tie="filename"):
    return best_by_snr(df, by, snr, tie)

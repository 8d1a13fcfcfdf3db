"""Dense positions, running totals and ranked values over a whole table without a single-task window."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from ..functions.missing import number
from ..session import freeze, handed_over

LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _partitions(df, partitions):
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _range_sorted(df, order, partitions):
    """Frozen rows with their range partition (`__part`) and place in it (`__place`).

    The order columns should identify a row, so that no range boundary falls into a run
    of equal keys and the partitions come out even. The rows are written once, because
    sampling the boundaries again could place them differently.
    """
    ranged = df.repartitionByRange(_partitions(df, partitions), *order).sortWithinPartitions(*order)
    marked = ranged.withColumn("__id", F.monotonically_increasing_id())
    frozen = freeze(marked)
    return frozen.withColumns(
        {
            "__part": F.shiftright("__id", LOCAL_BITS),
            "__place": F.col("__id").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)),
        }
    ).drop("__id")


def _before(placed, totals):
    """Per name of `totals` its sum over the range partitions before each one, as a column, and overall.

    One job; one row per range partition passes through the driver.
    """
    sums = placed.groupBy("__part").agg(*[F.sum(c).alias(n) for n, c in totals.items()]).collect()
    by_part = {r["__part"]: r for r in sums}
    out = {}
    for n in totals:
        before, so_far = [], 0
        for part in range(max(by_part, default=-1) + 1):
            before.append(so_far)
            so_far += (by_part[part][n] if part in by_part else 0) or 0
        out[n] = (F.get(F.lit(before or [0]), F.col("__part").cast("int")), so_far)
    return out


def positions_and_count(df, *order, name="position", partitions=None):
    """Rows with their 0-based rank in the given order, and the number of rows."""
    placed = _range_sorted(df, order, partitions)
    before, count = _before(placed, {"count": F.lit(1)})["count"]
    return placed.withColumn(name, F.col("__place") + before).drop("__part", "__place"), count


def with_positions(df, *order, name="position", partitions=None):
    """Add the 0-based rank of each row in the given order."""
    return positions_and_count(df, *order, name=name, partitions=partitions)[0]


def _cumulated(placed, names):
    """`placed` with the columns `names` summed up inside each range partition, in the order they are stored."""

    def work(batches):
        part, so_far = None, {}
        for batch in batches:
            parts = batch.column("__part").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(parts)) + 1
            columns = list(batch.columns)
            for name in names:
                at = batch.schema.names.index(name)
                values = columns[at].fill_null(0).to_numpy(zero_copy_only=False).copy()
                # a batch holds rows of one range, or whole small ranges one after the other
                for i, rows in enumerate(np.split(np.arange(len(values)), starts)):
                    if len(rows):
                        carry = so_far.get(name, 0) if i == 0 and parts[0] == part else 0
                        values[rows] = np.cumsum(values[rows]) + carry
                if len(values):
                    so_far[name] = values[-1]
                columns[at] = pa.array(values)
            if len(parts):
                part = parts[-1]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return placed.mapInArrow(work, placed.schema)


def with_running_totals(df, order, totals, partitions=None):
    """Add inclusive running sums in the given order; `totals` maps new name -> column.

    The sums are made where the sorted ranges are stored: nothing is shuffled or sorted after that.
    """
    order = [order] if isinstance(order, str) else list(order)
    names = {n: f"__total_{n}" for n in totals}
    marked = df.withColumns({names[n]: c for n, c in totals.items()})
    summed = {f.name: "bigint" if isinstance(f.dataType, T.IntegralType) else "double" for f in marked.schema}
    marked = marked.withColumns({c: F.col(c).cast(summed[c]) for c in names.values()})
    placed = _range_sorted(marked, order, partitions).drop("__place")
    before = _before(placed, {c: F.col(c) for c in names.values()})
    inside = _cumulated(placed, list(names.values()))
    return inside.select(*df.columns, *[(F.col(c) + before[c][0]).alias(n) for n, c in names.items()])


BINS = 4096


def ranked_values(df, col, *ranks):
    """The values at 0-based `ranks` (functions of the count), smallest first; missing ones have no rank.

    Selection by histogram: a pass counts the values per bin of the range in question and keeps every
    bin's least and greatest; the bin with the rank is the next range, until it holds one value. No row
    is sorted, and a value that fills the table is spread over all tasks, as each counts its own part.
    """
    values = df.select(number(col).alias("v")).filter(F.col("v").isNotNull())
    values = handed_over(values, "values")
    first = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    return [_select(values, rank(first["n"]), first["low"], first["high"]) if first["n"] else None for rank in ranks]


def _select(values, rank, low, high):
    while low < high:
        inside = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        if low == float("-inf") or high == float("inf"):
            # infinities stand apart from the finite values
            place = F.when(F.col("v") == float("-inf"), -1).when(F.col("v") == float("inf"), 1).otherwise(0)
        else:
            # halves, so that the widest range there is does not overflow
            share = (F.col("v") / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
            place = F.least(F.floor(share * BINS), F.lit(BINS - 1))
            if high / 2 - low / 2 == 0:  # neighbours too small to be halved
                place = (F.col("v") > low).cast("int")
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in sorted(bins.collect(), key=lambda r: r["low"]):
            if rank < row["n"]:
                low, high = row["low"], row["high"]
                break
            rank -= row["n"]
    return low


def with_group_positions(df, group, *order, name="position", partitions=None):
    """0-based rank within `group`, also when a few groups hold nearly all rows; NULL is a group."""
    ranked = with_positions(df, group, *order, name="__pos", partitions=partitions)
    starts = ranked.groupBy(F.col(group).alias("__group")).agg(F.min("__pos").alias("__start"))
    return (
        ranked.join(starts, F.col(group).eqNullSafe(F.col("__group")))
        .withColumn(name, F.col("__pos") - F.col("__start"))
        .drop("__pos", "__start", "__group")
    )

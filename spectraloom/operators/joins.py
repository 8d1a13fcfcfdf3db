"""Joins of catalogue tables, metadata and file listings.

A broadcast is only asked for after counting (`counted_side`). All other joins are left to
Spark, which broadcasts a side when its measured size is under
`spark.sql.autoBroadcastJoinThreshold`, and splits skewed partitions otherwise.
"""

from functools import reduce

from pyspark.sql import functions as F

from .dedup import keep_first, keep_last
from .sizes import counted_side  # noqa: F401


def side_by_side(tables, names, position="row_idx"):
    """Row-aligned tables joined on an explicit position; clashing names get `_<table>`."""
    columns = [c for t in tables for c in t.columns if c != position]
    # names are compared as Spark resolves them, without regard to case
    folded = [c.lower() for c in columns]
    clashing = {c for c in folded if folded.count(c) > 1}
    renamed = []
    for table, name in zip(tables, names):
        new = {c: f"{c}_{name}" for c in table.columns if c != position and c.lower() in clashing}
        renamed.append(table.withColumnsRenamed(new))
    return reduce(lambda a, b: a.join(b, position, "full_outer"), renamed)


def attach_metadata(spectra, metadata, keys=("agn_type", "filename"), order="row_idx"):
    """Left join with catalogue metadata; of several metadata rows the last one counts."""
    keys = list(keys)
    single = keep_last(metadata, keys, order).drop(order)
    return spectra.join(single, keys, "left")


def not_present(targets, present, key="filename"):
    """Targets without a file yet."""
    return targets.join(present.select(key).distinct(), key, "left_anti")


def pairs_with_files(pairs, listing, first="dr16_path", second="sdssv_path"):
    """Pairs whose two files exist, and a log of the others with the missing side."""
    files = listing.select("path").distinct()
    has_first = files.select(F.col("path").alias(first), F.lit(True).alias("__has_first"))
    has_second = files.select(F.col("path").alias(second), F.lit(True).alias("__has_second"))
    marked = pairs.join(has_first, first, "left").join(has_second, second, "left")
    marked = marked.select(*pairs.columns, "__has_first", "__has_second")
    both = F.col("__has_first").isNotNull() & F.col("__has_second").isNotNull()
    kept = marked.filter(both).drop("__has_first", "__has_second")
    side = F.concat_ws(
        "+",
        F.when(F.col("__has_first").isNull(), "dr16"),
        F.when(F.col("__has_second").isNull(), "sdssv"),
    )
    log = marked.filter(~both).withColumns({"skip_reason": F.lit("missing_file"), "missing_side": side})
    return kept, log.drop("__has_first", "__has_second")


def merge_keep_existing(existing, new, key="filename", existing_order=None, new_order=None):
    """Existing rows plus new ones with an unseen key; columns may differ.

    Each side is reduced to its first row per key when an order is given.
    """
    if existing_order:
        existing = keep_first(existing, key, existing_order)
    if new_order:
        new = keep_first(new, key, new_order)
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def with_errors(results, errors):
    """Results and error rows in one table."""
    return results.unionByName(errors, allowMissingColumns=True)

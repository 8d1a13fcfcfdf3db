"""A catalogue in hash partitions of its key, merged with new rows partition by partition.

The number of partitions is part of the layout (`partitions=<n>/partition=<i>`), so that every merge
finds rows where the first write put them. A merge reads and writes only partitions that gain a row.
"""

from pyspark.sql import functions as F

from ..session import handed_over

PARTITIONS = 64
LAYOUT = ("partitions", "partition")


def _placed(df, key, partitions):
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(partitions)).cast("int")
    return df.withColumns({"partitions": F.lit(partitions), "partition": place})


def _write(df, path, partitions):
    writer = df.repartition(partitions, "partition").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def write_partitioned(df, path, key="filename", partitions=PARTITIONS):
    _write(_placed(df, key, partitions), path, partitions)


def read_partitioned(spark, path):
    return spark.read.parquet(path).drop(*LAYOUT)


def _numbers(rows):
    """Partitions with rows; their number is bounded by the layout."""
    return [r[0] for r in rows.select("partition").distinct().collect()]


def unseen(df, path, key="filename"):
    """Rows of `df` whose key the catalogue does not have; keys of partitions without such a row are not read."""
    stored = df.sparkSession.read.parquet(path)
    partitions = stored.select("partitions").first()[0]
    placed = _placed(df, key, partitions)
    keys = stored.filter(F.col("partition").isin(_numbers(placed))).select(key).distinct()
    return placed.join(keys, key, "left_anti")


def merge_partitioned(new, path, key="filename"):
    """Add the rows of `new` with an unseen key; each key of `new` is expected once. Returns how many were added.

    New rows are stored once before anything is replaced. Partitions that gain no row keep their files.
    """
    fresh = handed_over(unseen(new, path, key), "fresh")
    gaining = _numbers(fresh)
    if gaining:
        stored = new.sparkSession.read.parquet(path)
        partitions = stored.select("partitions").first()[0]
        kept = stored.filter(F.col("partition").isin(gaining))
        _write(kept.unionByName(fresh, allowMissingColumns=True), path, partitions)
    return fresh.count()

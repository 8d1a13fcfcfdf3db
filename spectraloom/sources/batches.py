"""Tables that grow batch by batch, each batch once.

A batch writes partitions of its own (`batch=<key>`), which a second attempt at it replaces. It counts
from its commit on: one small file under the table's `_commits`, written last, for all tables the batch
has written to. What an attempt left that was never committed is seen by no reader of `committed` and is
no known key.

The keys of a table are kept apart from its wide rows, in `_keys`, by hash bucket: a batch looks up the
buckets its own keys fall into, and only those are listed and read.
"""

from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKETS = 64


def batch_key(source, number):
    """A batch's name; `source` identifies the stream."""
    return f"b-{source}-{number}"


def key_bucket(key, buckets=BUCKETS):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def existing_parquet(spark, path, schema, base=None):
    """The table under `path`, or None if nothing has been written there yet."""
    try:
        reader = spark.read.schema(schema)
        return (reader.option("basePath", base) if base else reader).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_batch(df, path, batch, by=(), order=()):
    """`df` as the partitions of `batch`; those an earlier attempt wrote are replaced."""
    df = df.withColumn("batch", F.lit(batch))
    if order:
        df = df.sortWithinPartitions(*by, "batch", *order)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by, "batch").parquet(path)


def write_keys(rows, path, batch, key="filename", buckets=BUCKETS):
    """The keys of `rows` to the bucketed key table of `path`, one file per bucket."""
    keys = rows.select(key, key_bucket(key, buckets).alias("bucket")).repartition(buckets, "bucket")
    write_batch(keys, f"{path}/_keys", batch, by=("bucket",))


def commit_batch(spark, path, batch):
    """From now on the batch counts."""
    write_batch(spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1), f"{path}/_commits", batch)


def commits(spark, path):
    """(batch): one row per committed batch, or None before the first."""
    found = existing_parquet(spark, f"{path}/_commits", "at timestamp, batch string")
    return None if found is None else found.select("batch").distinct()


def committed(spark, path, schema, log=None):
    """The rows of committed batches; `log` is the table that holds the commits, if it is another one."""
    rows = existing_parquet(spark, path, schema + ", batch string")
    done = commits(spark, log or path)
    if rows is None or done is None:
        return spark.createDataFrame([], schema)
    return rows.join(done, "batch", "left_semi").drop("batch")


def known_keys(spark, path, rows, batch, key="filename", log=None, buckets=BUCKETS):
    """Keys that committed batches other than `batch` have in the buckets of `rows`; None if there is no table.

    At most `buckets` numbers reach the driver.
    """
    mine = sorted(r[0] for r in rows.select(key_bucket(key, buckets)).distinct().collect() if r[0] is not None)
    done = commits(spark, log or path)
    if not mine or done is None:
        return None
    base = f"{path}/_keys"
    keys = existing_parquet(spark, f"{base}/bucket={{{','.join(map(str, mine))}}}", f"{key} string, bucket int, batch string", base)
    if keys is None:
        return None
    return keys.filter(F.col("batch") != batch).join(done, "batch", "left_semi").select(key).distinct()

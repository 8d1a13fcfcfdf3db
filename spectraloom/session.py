"""Session factory and the shared folder for checkpoints and hand-off tables."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus="*", shuffle_partitions=8, memory="16g", **conf):
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("spectraloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark):
    """The cluster's `spark.checkpoint.dir`; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="spectraloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def freeze(df):
    """Write `df` to the shared folder once, cutting its lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def handed_over(df, name, by=None, buckets=None):
    """`df` written once to the shared folder as Parquet, for several readers of some of its columns.

    With `by`, its rows are bucketed by these columns (as many buckets as shuffle partitions, unless
    given): joins and aggregates on exactly these columns read them without an exchange. Buckets are
    known to Spark through a table, which is registered under a name of its own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if not by:
        df.write.parquet(path)
        return spark.read.parquet(path)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(table)
    return spark.table(table)


def scratch_path(spark, name):
    """A fresh path for a hand-off table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

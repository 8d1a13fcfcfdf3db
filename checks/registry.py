"""Registry of checked queries: a Spark job and, where SQL can say it, the same in SQL."""

from pyspark.sql import functions as F

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(col, digits):
    """Rounded, with -0.0 turned into 0.0 so that equal values look equal."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def long_vector(df, ids, vector, digits):
    """One row per element, rounded."""
    return df.select(*ids, F.posexplode(vector).alias("pos", "v")).select(
        *ids, F.col("pos").cast("bigint").alias("pos"), rnd("v", digits).alias("value")
    )

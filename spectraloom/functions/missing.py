"""One missing value: NULL. NaN scalars become NULL, masks never yield NULL."""

from pyspark.sql import functions as F, types as T


def number(col):
    """`col` as DOUBLE with NaN turned into NULL (Spark orders NaN above every number)."""
    col = F.col(col) if isinstance(col, str) else col
    col = col.cast("double")
    return F.when(~F.isnan(col), col)


def at_least(col, limit):
    """A filter `col >= limit` that drops NULL and NaN; its comparison reaches a Parquet scan."""
    col = F.col(col) if isinstance(col, str) else col
    return (col >= limit) & ~F.isnan(col)


def holds(condition):
    """A mask that is false, not NULL, where an operand is missing."""
    return F.coalesce(condition, F.lit(False))


def finite(col):
    col = number(col)
    return holds(F.abs(col) < F.lit(float("inf")))


def finite_positive(col):
    col = number(col)
    return holds((col > 0) & (col < F.lit(float("inf"))))


def nan_to_null(df):
    """Apply the missing-value rule to every floating point scalar of `df`."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})

"""Column clean-up and the three layouts of a spectrum table."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from ..session import handed_over
from ..settings import CORE_COLUMNS, LINE_COLUMNS


def decode_strings(df, columns=None, strip=True):
    """Byte strings to text, optionally without surrounding white space."""
    binary = [f.name for f in df.schema if isinstance(f.dataType, T.BinaryType)]
    chosen = [c for c in binary if columns is None or c in columns]

    def text(c):
        decoded = F.decode(F.col(c), "UTF-8")
        return F.regexp_replace(decoded, r"^\s+|\s+$", "") if strip else decoded

    return df.withColumns({c: text(c) for c in chosen})


def keep_renamed(df, columns, renames=None, optional=()):
    """A fixed list of columns, optional ones where they exist, then renames."""
    chosen = list(columns) + [c for c in optional if c in df.columns]
    return df.select(*chosen).withColumnsRenamed(renames or {})


def flux_columns(df, meta=CORE_COLUMNS + LINE_COLUMNS):
    """Wide-layout pixel columns: everything that is not metadata, with wavelengths."""
    names = [c for c in df.columns if c not in meta]
    return names, [float(c) for c in names]


def wide_to_array(df, meta=CORE_COLUMNS + LINE_COLUMNS):
    names, _ = flux_columns(df, meta)
    kept = [c for c in df.columns if c in meta]
    return df.select(*kept, F.array(*[F.col(f"`{n}`").cast("float") for n in names]).alias("flux"))


def array_to_wide(df, grid, flux="flux"):
    others = [c for c in df.columns if c != flux]
    return df.select(*others, *[F.get(flux, F.lit(i)).alias(str(float(w))) for i, w in enumerate(grid)])


def array_to_long(df, columns, flux="flux"):
    """One row per pixel."""
    return df.select(*columns, F.posexplode(flux).alias("pos", "value"))


def class_target(agn_type="agn_type"):
    """Type 1 is 0, type 2 is 1."""
    return (F.col(agn_type) == 2).cast("int")


MOMENTS = "n array<bigint>, mean array<double>, m2 array<double>, zeros array<bigint>"
#: partial rows that meet in one merge; more are merged in rounds
FAN_IN = 256


def _merge(a, b):
    """Two sets of moments (counts, means, sums of squared deviations, zeros per pixel) as one."""
    size = max(len(a[0]), len(b[0]))
    a, b = ([np.pad(x, (0, size - len(x))) for x in side] for side in (a, b))
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    off = np.where(a[0] == 0, 0.0, b[1] - a[1])
    mean = np.where(a[0] == 0, b[1], a[1] + off * share)
    return n, mean, a[2] + b[2] + off**2 * a[0] * share, a[3] + b[3]


def _batch_moments(vectors):
    """Moments of a list array, per pixel over its rows; missing values are left out, NaN counts."""
    lengths = pc.fill_null(vectors.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    value = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    pixel = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    size = int(lengths.max(initial=0))
    at, x = pixel[known], value[known]
    n = np.bincount(at, minlength=size)
    mean = np.bincount(at, x, minlength=size) / np.maximum(n, 1)
    return n, mean, np.bincount(at, (x - mean[at]) ** 2, minlength=size), np.bincount(at, x == 0, minlength=size).astype(np.int64)


def _moment_batch(key, sums):
    columns = [pa.array([x.tolist()], pa.list_(pa.int64() if x.dtype.kind == "i" else pa.float64())) for x in sums]
    return pa.RecordBatch.from_arrays([key, *columns], names=["key", "n", "mean", "m2", "zeros"])


def vector_moments(df, by=None, flux="flux"):
    """(key, n, mean, m2, zeros): the moments of the vectors, a row per task and class; `key` is `by` or NULL.

    Classes are expected to be few: a task holds one set of moments for each it meets.
    """
    key = (F.col(by) if by else F.lit(None).cast("int")).alias("key")
    rows = df.select(key, F.col(flux).cast("array<double>").alias("flux"))
    kind = dict(rows.dtypes)["key"]

    def work(batches):
        held, keys = {}, {}
        for batch in batches:
            found = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = found.indices.to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                value = found.dictionary.slice(int(code), 1)
                name = value[0].as_py()
                sums = _batch_moments(batch.column(1).filter(pa.array(codes == code)))
                held[name] = _merge(held[name], sums) if name in held else sums
                keys[name] = value
        for name, sums in held.items():
            yield _moment_batch(keys[name], sums)

    return rows.mapInArrow(work, f"key {kind}, {MOMENTS}")


def merged_moments(moments, tasks):
    """One row per key of `vector_moments`, of `tasks` tasks: at most `FAN_IN` rows of a key meet at a time."""
    kind = dict(moments.dtypes)["key"]

    def merge(table):
        parts = [[np.array(x if x is not None else []) for x in row] for row in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "m2", "zeros")))]
        sums = reduce(_merge, [(n.astype(np.int64), m.astype(float), s.astype(float), z.astype(np.int64)) for n, m, s, z in parts])
        return pa.Table.from_batches([_moment_batch(table.column("key").combine_chunks().slice(0, 1), sums)])

    schema = f"key {kind}, {MOMENTS}"
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        salted = moments.withColumn("salt", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(tasks)))
        moments = salted.groupBy("key", "salt").applyInArrow(lambda t: merge(t), schema)
    return moments.groupBy("key").applyInArrow(lambda t: merge(t), schema)


def _moments(df, by, flux):
    moments = handed_over(vector_moments(df, by, flux), "moments")
    # a task writes one row per class it meets
    largest = moments.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    return merged_moments(moments, largest)


def safe_range(df, grid, flux="flux"):
    """First and last wavelength whose pixel is not zero in any row."""
    pixels = _moments(df, None, flux).select(F.posexplode("zeros").alias("pos", "zeros"))
    wave = F.element_at(F.lit([float(w) for w in grid]), F.col("pos") + 1)
    return (
        pixels.filter("zeros = 0")
        .agg(F.min(wave).alias("blue_limit"), F.max(wave).alias("red_limit"))
        .withColumn("valid_range", F.col("red_limit") - F.col("blue_limit"))
    )


def class_profiles(df, by, flux="flux"):
    """Element-wise mean and population std of the vectors of each class; NULL for a pixel without values."""
    some = lambda x, n: F.when(n > 0, x)
    return _moments(df, by, flux).select(
        F.col("key").alias(by),
        F.zip_with("mean", "n", some).alias("mean"),
        F.zip_with("m2", "n", lambda s, n: F.when(n > 0, F.sqrt(s / n))).alias("std"),
    )


def spectrum_by_filename(df, filename):
    return df.filter(F.col("filename") == filename).limit(1)


def spectrum_by_ordinal(df, ordinal, column="row_idx"):
    return df.filter(F.col(column) == ordinal).limit(1)


def get_spectrum(df, identifier, grid):
    """Wavelengths, flux and metadata of one spectrum, by file name or ordinal."""
    if isinstance(identifier, bool) or not isinstance(identifier, (int, str)):
        raise TypeError("identifier must be a row number or a file name")
    by_name = isinstance(identifier, str)
    found = (spectrum_by_filename if by_name else spectrum_by_ordinal)(df, identifier).head(1)
    if not found:
        raise ValueError(f"spectrum {identifier!r} not found")
    row = found[0].asDict()
    flux = row.pop("flux")
    return list(grid), flux, row

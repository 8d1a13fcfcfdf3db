"""Run results as JSON and the table sinks."""

from pyspark.sql import functions as F, types as T

METRICS = (
    "struct<macro_f1: double, balanced_accuracy: double, type1_recall: double, type2_recall: double, "
    "confusion_matrix: array<array<bigint>>>"
)
RUN_SCHEMA = (
    "run_name string, seed int, focal_alpha double, focal_gamma double, best_epoch int, "
    f"best_val_f1_during_training double, val_metrics {METRICS}, test_metrics {METRICS}, model_path string"
)


def read_run_results(spark, path, schema=RUN_SCHEMA, multi_line=True):
    """One row per run from result or sweep-summary documents, or from JSON lines."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def write_json(df, path, mode="errorifexists"):
    df.write.mode(mode).json(path)


def as_json_text(df):
    """One JSON document per row in a single `json` column."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


#: columns that spectra are looked up by, and the distinct values a row group is prepared for
LOOKUP_COLUMNS = ("filename", "obj_id")
LOOKUP_VALUES = 200_000


def write_lookup_catalogue(df, path, mode="errorifexists", ordinal="row_idx", row_group_mb=None):
    """Parquet for lookups of single spectra: sorted by `ordinal`, bloom filters on file and object names.

    An ordinal is found by the bounds of its row group, a name by the bloom filters: a lookup decodes
    the vectors of about one row group, however large the catalogue is.
    """
    writer = df.repartitionByRange(ordinal).sortWithinPartitions(ordinal).write.mode(mode)
    for name in (c for c in LOOKUP_COLUMNS if c in df.columns):
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{name}", LOOKUP_VALUES)
    if row_group_mb is not None:
        writer = writer.option("parquet.block.size", int(row_group_mb * 2**20))
    writer.parquet(path)


def write_catalogue(df, path, mode="errorifexists", partition_by_class=False):
    """Parquet in array layout, sorted so that class and SNR filters skip row groups."""
    writer = df.sortWithinPartitions("agn_type", "snr").write.mode(mode)
    if partition_by_class:
        writer = writer.partitionBy("agn_type")
    writer.parquet(path)


def write_csv(df, path, mode="errorifexists"):
    """CSV of the scalar columns."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = df.select(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, nested)])
    flat.write.mode(mode).csv(path, header=True)

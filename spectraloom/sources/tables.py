"""Reading catalogues, candidate tables, spectra and pair manifests."""

from pyspark.sql import functions as F, types as T

from ..functions.missing import nan_to_null
from ..settings import LINE_COLUMNS

LINE_FIELD_TYPES = {
    "OIII_VALID": "boolean",
    "OIII_USABLE": "boolean",
    "OIII_QUALITY_FLAG": "string",
    "OIII_FLUX_SOURCE": "string",
}

CANDIDATE_SCHEMA = (
    "filename string, SDSS_NAME string, RA double, DEC double, z double, mjd int, PLATE int, fiber int, "
    "snr double, OIII_FLUX double, OIII_FLUX_ERR double, OIII_LUM double, OIII_LUM_ERR double, "
    "LOG_OIII_LUM double, LOG_OIII_LUM_ERR double, OIII_SNR double, OIII_SIGMA double, OIII_VOFF double, "
    "OIII_CHI2 double, OIII_VALID boolean, OIII_QUALITY_FLAG string"
)

PREDICTION_SCHEMA = (
    "sdssid bigint, z double, specname_dr16 string, specname_sdssv string, dr16_path string, "
    "sdssv_path string, true_label int, prob_change double, pred_label int, is_false_positive int, "
    "is_false_negative int"
)


def processed_schema():
    """The stored catalogue: core columns, flux vector, line columns, processing notes."""
    lines = ", ".join(f"{c} {LINE_FIELD_TYPES.get(c, 'double')}" for c in LINE_COLUMNS)
    return (
        "filename string, obj_id string, agn_type int, z double, snr double, flux array<float>, "
        f"n_filled int, {lines}"
    )


def read_catalogue(spark, path, columns=None):
    """Processed spectra; name the columns you need so that others are not read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark, path, schema):
    """CSV with a given schema; missing numbers are NULL afterwards."""
    df = spark.read.schema(schema).csv(path, header=True, nanValue="NaN")
    return nan_to_null(df)


def scalar_columns(df):
    """Keep one-dimensional columns only."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, nested)])


def read_survey_table(spark, path):
    return nan_to_null(scalar_columns(spark.read.parquet(path)))


def read_spectra(spark, type1_path, type2_path):
    """Raw spectra of two folders, tagged with their class."""
    parts = []
    for agn_type, path in ((1, type1_path), (2, type2_path)):
        df = spark.read.parquet(path)
        if "filename" not in df.columns:
            df = df.withColumn("filename", F.col("_metadata.file_name"))
        parts.append(df.withColumn("agn_type", F.lit(agn_type)))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


MANIFEST_COLUMNS = ("sdssid", "z", "specname_dr16", "specname_sdssv")


def checked_manifest(df, require_label=True):
    """A pair manifest with all required columns; label -1 where labels are not required."""
    required = list(MANIFEST_COLUMNS) + (["label"] if require_label else [])
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required manifest columns: {absent}")
    return df if require_label else df.withColumn("label", F.lit(-1))


def read_manifest(spark, path, require_label=True):
    if path.endswith(".csv"):
        schema = "sdssid bigint, z double, specname_dr16 string, specname_sdssv string"
        schema += ", label int" if require_label else ""
        return checked_manifest(read_csv(spark, path, schema), require_label)
    return checked_manifest(spark.read.parquet(path), require_label)

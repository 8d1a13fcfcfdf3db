"""Candidate catalogues of both classes and the list of spectra still to fetch."""

from pyspark.sql import functions as F

from ..functions.lines import (
    ensure_columns,
    flux_from_luminosity,
    luminosity_from_flux,
    quality_flags,
    standardize_line_columns,
)
from ..functions.missing import nan_to_null
from ..functions.naming import archive_url, first_present, legacy_filename, spectrum_filename
from ..operators.dedup import keep_first
from ..operators.joins import not_present, side_by_side
from ..operators.select import select_type1, select_type2, two_line_snr
from ..operators.shape import decode_strings, keep_renamed
from ..settings import TYPE1_BASE, TYPE1_LINES, TYPE1_RENAMES, QualityLimits
from ..sources.tables import scalar_columns

FIT_COLUMNS = ("OIII_SIGMA", "OIII_VOFF", "OIII_CHI2")


def type2_candidates(class_df, info_df, line_df=None, snr_threshold=5, limits=QualityLimits()):
    """Row-aligned class, info and line tables to flagged narrow-line candidates."""
    tables, names = [class_df, info_df], ["class_table", "info_table"]
    if line_df is not None:
        tables, names = tables + [line_df], names + ["line_table"]
    joined = side_by_side([scalar_columns(t) for t in tables], names)
    # filters first, on bare columns, so that they reach the scans
    df = nan_to_null(select_type2(decode_strings(joined), snr_threshold))
    if {"OIII_FLUX", "OIII_FLUX_ERR"} <= set(df.columns):
        df = luminosity_from_flux(df)
    else:
        df = ensure_columns(
            df, ["OIII_FLUX", "OIII_FLUX_ERR", "OIII_LUM", "OIII_LUM_ERR", "LOG_OIII_LUM", "OIII_SNR"]
        )
    return ensure_columns(quality_flags(df, limits), FIT_COLUMNS)


def type1_candidates(df, z_threshold=0.4, snr_threshold=5.0, limits=QualityLimits()):
    """Quasar table to flagged broad-line candidates in the fixed output layout."""
    df = nan_to_null(select_type1(scalar_columns(df), z_threshold, snr_threshold))
    df = decode_strings(df, ["SDSS_NAME"])
    df = df.withColumn("filename", legacy_filename("PLATE", "MJD", "FIBER"))
    df = df.withColumnRenamed("REDSHIFT", "z")
    df = quality_flags(flux_from_luminosity(standardize_line_columns(df)), limits)
    return keep_renamed(df, TYPE1_BASE + TYPE1_LINES, TYPE1_RENAMES)


def find_candidates(df, z_threshold=None, snr_threshold=None):
    """Generic search: no broad absorption, optional redshift and line limits."""
    df = scalar_columns(df).filter(F.col("BAL_FLAG") == 0)
    z_col = first_present(df, ("REDSHIFT", "z"), "redshift")
    if z_threshold is not None:
        df = df.filter(F.col(z_col) < z_threshold)
    if snr_threshold is not None:
        df = df.filter(two_line_snr("LINE_MED_SN_HB", "LINE_MED_SN_HA", snr_threshold))
    df = nan_to_null(df)
    mjd_col = first_present(df, ("SMJD", "MJD"), "MJD")
    df = df.withColumn("filename", legacy_filename("PLATE", mjd_col, "FIBER"))
    df = decode_strings(df, ["SDSS_NAME"], strip=False)
    kept = ["filename", "SDSS_NAME", "RA", "DEC", z_col, mjd_col, "PLATE", "FIBER"]
    return keep_renamed(df, kept, {mjd_col: "mjd"}, optional=("FIELD", "OBJID", "SPECOBJID"))


TYPE1_KEYS = ("PLATE", "mjd", "fiber")
TYPE2_KEYS = ("PLATE", "MJD_class_table", "FIBERID_class_table")


def unique_targets(candidates, keys, order="row_idx"):
    """First row per plate, MJD and fiber."""
    return keep_first(candidates, list(keys), order)


def download_manifest(candidates, present, keys=TYPE1_KEYS, order="row_idx"):
    """File name and URL of every target without a file among `present`."""
    targets = unique_targets(candidates, keys, order)
    plate, mjd, fiber = keys
    listed = targets.select(
        F.col(plate).cast("int").alias("plate"),
        F.col(mjd).cast("int").alias("mjd"),
        F.col(fiber).cast("int").alias("fiber"),
        spectrum_filename(targets).alias("filename"),
        archive_url(plate, mjd, fiber).alias("url"),
    )
    return not_present(listed, present)


def download_status(manifest, done, key="filename"):
    """Targets per status: downloaded where listed in `done`, else pending."""
    listed = done.select(key, F.lit("downloaded").alias("status")).distinct()
    status = F.coalesce(F.col("status"), F.lit("pending")).alias("status")
    return manifest.join(listed, key, "left").groupBy(status).agg(F.count("*").alias("count"))

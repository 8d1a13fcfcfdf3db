"""Raw spectra to the cleaned catalogue."""

from functools import partial

from pyspark.sql import functions as F

from ..functions.lines import common_line_flux
from ..functions.naming import spectrum_filename
from ..functions.spectra import prepared_spectrum
from ..functions.vectors import wavelength_axis
from ..operators.dedup import keep_first
from ..operators.joins import attach_metadata, merge_keep_existing
from ..operators.select import clean_spectra, split_processed
from ..settings import CONTINUUM_WINDOW, LINE_COLUMNS, TAPER_LEN, master_grid
from ..session import handed_over
from ..sources.partitions import LAYOUT, merge_partitioned, unseen
from ..sources.results import write_catalogue
from ..sources.tables import LINE_FIELD_TYPES

HEADER_COLUMNS = ("loglam", "wavelength", "coeff0", "coeff1", "crval1", "cdelt1")


def observed_wavelengths(df, flux="flux"):
    """The wavelength axis from whichever of the header columns exist, in upper or lower case."""
    have = {c.lower(): c for c in df.columns if c.lower() in HEADER_COLUMNS}
    for pair in (("coeff0", "coeff1"), ("crval1", "cdelt1")):
        if not all(c in have for c in pair):
            have = {c: name for c, name in have.items() if c not in pair}
    if not have:
        raise ValueError(f"no wavelength axis: none of {HEADER_COLUMNS} among {df.columns}")
    return wavelength_axis(flux, **have)


def preprocess_spectra(
    df, grid=None, window=CONTINUUM_WINDOW, taper_len=TAPER_LEN, mad_scaling=False, sanitize=False
):
    """Add the processed `flux`, `n_filled` and `error` to one row per raw spectrum.

    A spectrum without redshift or SNR keeps a NULL vector and an error text.
    """
    grid = master_grid() if grid is None else grid
    known = F.col("z").isNotNull() & F.col("snr").isNotNull()
    result = prepared_spectrum(
        observed_wavelengths(df), F.col("flux"), F.when(known, F.col("z")), grid, window, taper_len,
        mad_scaling, sanitize,
    )
    if "obj_id" in df.columns:
        obj_id = F.coalesce(F.col("obj_id").cast("string"), F.col("filename"))
    else:
        obj_id = F.col("filename")
    done = df.select("filename", obj_id.alias("obj_id"), "agn_type", "z", "snr", result.alias("__p"))
    missing = F.when(F.col("z").isNull() | F.col("snr").isNull(), F.lit("missing redshift or SNR"))
    return done.select(
        "filename",
        "obj_id",
        "agn_type",
        "z",
        "snr",
        F.col("__p.flux").alias("flux"),
        F.col("__p.n_filled").alias("n_filled"),
        F.coalesce(missing, F.col("__p.error")).alias("error"),
    )


def candidate_metadata(candidates, agn_type, order="row_idx"):
    """Line columns of a candidate table keyed by class and spectrum file name."""
    df = common_line_flux(candidates)
    lines = []
    for c in LINE_COLUMNS:
        kind = LINE_FIELD_TYPES.get(c, "double")
        lines.append((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c))
    return df.select(
        F.lit(agn_type).alias("agn_type"), spectrum_filename(df).alias("filename"), order, *lines
    )


def build_catalogue(spectra, type1_meta, type2_meta, order="row_idx", **options):
    """Processed spectra with line metadata, and the log of failures.

    Each class sees the metadata of its own candidate table only. The processed rows are written to
    the shared folder once and both results read them there, so the kernel runs once per spectrum. They
    are bucketed by class and file name: the metadata comes to the vectors, not the other way round.
    """
    processed = handed_over(preprocess_spectra(spectra, **options), "processed", by=("agn_type", "filename"))
    good, failed = split_processed(processed)
    meta = candidate_metadata(type1_meta, 1, order).unionByName(candidate_metadata(type2_meta, 2, order))
    log = failed.select("filename", "agn_type", F.lit("preprocessing_failed").alias("skip_reason"), "error")
    return attach_metadata(good.drop("error"), meta, order=order), log




def row_order():
    """Tells rows of one file name apart; the vector counts by its hash."""
    return ["obj_id", "agn_type", "z", "snr", F.xxhash64("flux").alias("vector")]


MODES = ("full", "new_only", "merge")


def run_preprocessing(
    spectra,
    type1_meta,
    type2_meta,
    output,
    mode="full",
    existing=None,
    require_valid_oiii=False,
    order="row_idx",
    **options,
):
    """Build, optionally merge with an existing catalogue, clean and write.

    `full` and `new_only` differ in the spectra handed in; `merge` keeps the existing row
    of a file name that both have, does not process its spectrum again, and leaves one row per file
    name on either side (the smallest by object, class, redshift, SNR and vector).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, choose from {MODES}")
    if mode == "merge":
        if existing is None:
            raise ValueError("mode 'merge' needs the existing catalogue")
        spectra = spectra.join(existing.select("filename").distinct(), "filename", "left_anti")
    catalogue, log = build_catalogue(spectra, type1_meta, type2_meta, order, **options)
    if mode == "merge":
        catalogue = merge_keep_existing(existing, catalogue, existing_order=row_order(), new_order=row_order())
    cleaned = clean_spectra(catalogue, require_valid_oiii=require_valid_oiii)
    write_catalogue(cleaned, output)
    return cleaned.sparkSession.read.parquet(output), log


def update_catalogue(spectra, type1_meta, type2_meta, path, require_valid_oiii=False, order="row_idx", **options):
    """Merge new spectra into a stored catalogue (`sources.partitions`) in place; returns the log of failures.

    As mode `merge`: stored rows stay, their spectra are not processed again, and one row per file name
    is added. Only partitions that gain a row are written; stored rows are taken as cleaned.
    """
    fresh = unseen(spectra, path).drop(*LAYOUT)
    catalogue, log = build_catalogue(fresh, type1_meta, type2_meta, order, **options)
    added = keep_first(catalogue, "filename", row_order())
    merge_partitioned(clean_spectra(added, require_valid_oiii=require_valid_oiii), path)
    return log


preprocess_real_spectra = partial(preprocess_spectra, sanitize=True)

"""Catalogue and spectrum filters."""

import inspect

from pyspark.sql import functions as F

from ..functions.lines import usable_flag
from ..functions.missing import at_least, holds, number
from ..functions.spectra import pixel_stats


def two_line_snr(hb_col, ha_col, threshold):
    """Each line is absent (<= 0) or strong enough, and at least one is strong enough.

    A filter condition: NULL, which a filter drops, where a line is NULL.
    """
    hb, ha = F.col(hb_col), F.col(ha_col)
    # comparisons of bare columns, so that a filter on them reaches the scan
    known = ~F.isnan(hb) & ~F.isnan(ha)
    absent_or_strong = ((hb <= 0) | (hb >= threshold)) & ((ha <= 0) | (ha >= threshold))
    return absent_or_strong & ((hb >= threshold) | (ha >= threshold)) & known


def select_type2(df, snr_threshold=5):
    """Narrow-line galaxies of good quality; `Z` becomes `z`."""
    df = df.filter(
        (F.col("I_CLASS") == 4)
        & (F.col("Z_WARNING") == 0)
        & at_least("SN_MEDIAN", snr_threshold)
        & (F.col("SPECTROTYPE") == "GALAXY")
        & ~F.coalesce(F.col("SUBCLASS"), F.lit("")).contains("BROADLINE")
    )
    df = df.withColumn("SUBCLASS", F.coalesce(F.col("SUBCLASS"), F.lit("")))
    # exact comparison: Spark resolves names without regard to case
    return df.withColumnRenamed("Z", "z") if "Z" in df.columns and "z" not in df.columns else df


def select_type1(df, z_threshold=0.4, snr_threshold=5.0):
    """Quasars without broad absorption below a redshift, with a usable line."""
    return df.filter(
        (F.col("BAL_FLAG") == 0)
        & (F.col("REDSHIFT") < z_threshold)
        & two_line_snr("LINE_MED_SN_HB", "LINE_MED_SN_HA", snr_threshold)
    )


def redshift_window(df, low=0.15, high=0.22, z_col="z"):
    # NaN is above every number, so the upper limit drops it
    return df.filter((F.col(z_col) > low) & (F.col(z_col) < high))


def split_processed(df):
    """Processed spectra and the log of those that failed."""
    good = df.filter(F.col("flux").isNotNull())
    failed = df.filter(F.col("flux").isNull())
    return good, failed


RULES = ("coverage", "outlier", "snr", "neg_flux", "oiii", "finite")


def cleaning_masks(
    df, max_zeros_pct=0.5, min_snr=5.0, max_flux_outlier=None, max_neg_flux=None, require_valid_oiii=False
):
    """Boolean columns ok_<rule>; rules that are switched off are always true."""
    df = df.withColumn("__pixels", pixel_stats("flux"))
    p = F.col("__pixels")
    on = F.lit(True)
    masks = {
        "coverage": holds(p["zero_fraction"] <= max_zeros_pct),
        "outlier": on if max_flux_outlier is None else holds(p["high"] <= max_flux_outlier),
        "snr": holds(number("snr") >= min_snr),
        "neg_flux": on if max_neg_flux is None else holds(p["low"] >= -max_neg_flux),
        "oiii": usable_flag(df) if require_valid_oiii else on,
        "finite": holds(p["any_finite"]),
    }
    return df.withColumns({f"ok_{name}": mask for name, mask in masks.items()}).drop("__pixels")


def clean_spectra(df, **limits):
    """Rows that pass every rule; the limit on the SNR reaches the scan."""
    min_snr = limits.get("min_snr", inspect.signature(cleaning_masks).parameters["min_snr"].default)
    masked = cleaning_masks(df.filter(at_least("snr", min_snr)), **limits)
    for rule in RULES:
        masked = masked.filter(F.col(f"ok_{rule}"))
    return masked.drop(*[f"ok_{rule}" for rule in RULES])


def cleaning_report(df, **limits):
    """Rows dropped by each rule on its own, and how many remain, in one pass."""
    masked = cleaning_masks(df, **limits)
    every = F.lit(True)
    for rule in RULES:
        every = every & F.col(f"ok_{rule}")

    def count(condition):
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))

    return masked.agg(
        F.count("*").alias("original"),
        *[count(~F.col(f"ok_{rule}")).alias(f"dropped_{rule}") for rule in RULES],
        count(every).alias("remaining"),
    )

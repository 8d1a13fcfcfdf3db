"""Emission-line columns: flux, luminosity, errors, signal-to-noise, quality flag."""

import math

from pyspark.sql import functions as F

from ..settings import EPS, FLUX_UNIT, LINE_ALIASES, STANDARD_LINE_COLUMNS, TRUE_WORDS, QualityLimits
from .cosmology import with_sphere_area
from .missing import finite, finite_positive, holds, number

AREA = "__area"
LN10 = math.log(10.0)


def _column_or_null(df, name):
    return number(name) if name in df.columns else F.lit(None).cast("double")


def _with_area(df, z_col):
    return with_sphere_area(df, number(z_col), AREA)


def ensure_columns(df, names, kind="double"):
    """Add the absent ones of `names` as all-missing columns."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def luminosity_from_flux(df, z_col="z", flux_col="OIII_FLUX", err_col="OIII_FLUX_ERR", unit=FLUX_UNIT):
    """L = 4 pi d^2 F with log10, error and SNR; all four outputs start from missing."""
    flux, err = number(flux_col), _column_or_null(df, err_col)
    area = F.col(AREA)
    valid = area.isNotNull() & (flux > 0)
    with_err = valid & (err > 0)
    lum = area * (flux * F.lit(unit))
    return (
        _with_area(df, z_col)
        .withColumns(
            {
                "OIII_LUM": F.when(valid, lum),
                "OIII_LUM_ERR": F.when(with_err, area * (err * F.lit(unit))),
                "LOG_OIII_LUM": F.when(valid, F.log10(lum)),
                "OIII_SNR": F.when(with_err, flux / err),
            }
        )
        .drop(AREA)
    )


def flux_from_luminosity(df, z_col="z", lum_col="OIII_LUM", err_col="OIII_LUM_ERR", unit=FLUX_UNIT):
    """F = L / (4 pi d^2), value and error independently; other values are kept."""
    lum, err = number(lum_col), _column_or_null(df, err_col)
    area = F.col(AREA)
    out = _with_area(ensure_columns(df, ["OIII_FLUX", "OIII_FLUX_ERR", "OIII_SNR"]), z_col)
    out = out.withColumns(
        {
            "OIII_FLUX": F.when(area.isNotNull() & (lum > 0), lum / area / F.lit(unit)).otherwise(
                number("OIII_FLUX")
            ),
            "OIII_FLUX_ERR": F.when(area.isNotNull() & (err > 0), err / area / F.lit(unit)).otherwise(
                number("OIII_FLUX_ERR")
            ),
        }
    )
    flux, ferr = F.col("OIII_FLUX"), F.col("OIII_FLUX_ERR")
    snr = F.when(flux.isNotNull() & (ferr > 0), flux / ferr).otherwise(number("OIII_SNR"))
    return out.withColumn("OIII_SNR", snr).drop(AREA)


def rename_line_aliases(df):
    """Copy the first catalogue name present to its standard name, unless that exists."""
    found = {}
    for standard, names in LINE_ALIASES.items():
        source = next((n for n in names if n in df.columns), None)
        if source is not None and standard not in df.columns:
            found[standard] = F.col(source)
    return df.withColumns(found) if found else df


def convert_log_luminosity(df):
    """Fill luminosity, log luminosity and both errors from one another."""
    log_l, err_log = number("LOG_OIII_LUM"), number("LOG_OIII_LUM_ERR")
    lum = F.when(finite_positive(log_l), F.pow(F.lit(10.0), log_l)).otherwise(number("OIII_LUM"))
    df = df.withColumn("OIII_LUM", lum)
    lum = F.col("OIII_LUM")
    df = df.withColumns(
        {
            "LOG_OIII_LUM": F.when(log_l.isNull() & finite_positive(lum), F.log10(lum)).otherwise(log_l),
            "OIII_LUM_ERR": F.when(
                finite_positive(err_log) & finite_positive(lum), F.lit(LN10) * lum * err_log
            ).otherwise(number("OIII_LUM_ERR")),
        }
    )
    lum_err = F.col("OIII_LUM_ERR")
    from_linear = err_log.isNull() & finite_positive(lum_err) & finite_positive(lum)
    return df.withColumn(
        "LOG_OIII_LUM_ERR", F.when(from_linear, lum_err / (F.lit(LN10) * lum)).otherwise(err_log)
    )


def standardize_line_columns(df):
    """Aliases, missing columns and log/linear conversion in one step."""
    return convert_log_luminosity(ensure_columns(rename_line_aliases(df), STANDARD_LINE_COLUMNS))


def line_column_counts(df, columns=STANDARD_LINE_COLUMNS[:4]):
    """Non-missing count per column."""
    return df.agg(*[F.count(number(c)).alias(c) for c in columns])


def common_line_flux(df, z_col="z"):
    """CGS flux with its source: catalogue flux first, else from luminosity."""
    df = ensure_columns(df, ["OIII_FLUX_CGS", "OIII_LUM"])
    lum = number("OIII_LUM")
    if "LOG_OIII_LUM" in df.columns:
        log_l = number("LOG_OIII_LUM")
        lum = F.when(lum.isNull() & finite(log_l), F.pow(F.lit(10.0), log_l)).otherwise(lum)
    df = df.withColumn("OIII_LUM", lum)

    direct = finite_positive("OIII_FLUX") if "OIII_FLUX" in df.columns else F.lit(False)
    flux = number("OIII_FLUX") if "OIII_FLUX" in df.columns else F.lit(None).cast("double")
    given = F.when(direct, flux * F.lit(FLUX_UNIT)).otherwise(number("OIII_FLUX_CGS"))
    if z_col in df.columns:
        df = _with_area(df, z_col)
        usable = finite(z_col) & F.col(AREA).isNotNull() & finite_positive("OIII_LUM")
        converted = given.isNull() & usable
        from_lum = F.col("OIII_LUM") / F.col(AREA)
    else:
        converted, from_lum = F.lit(False), F.lit(None).cast("double")
    df = df.withColumns(
        {
            "OIII_FLUX_SOURCE": F.when(converted, "luminosity_converted")
            .when(direct, "catalog_flux")
            .otherwise("missing"),
            "OIII_FLUX_CGS": F.when(converted, from_lum).otherwise(given),
        }
    )
    return df.withColumn("OIII_USABLE", finite_positive("OIII_FLUX_CGS")).drop(AREA)


def _quality_rules(df, limits):
    """(name, mask) pairs in the order they are applied; a later match replaces the text."""
    have = set(df.columns)
    rules = []
    for name, label in (("OIII_FLUX", "flux"), ("OIII_FLUX_ERR", "flux_err")):
        if name in have:
            value = number(name)
            rules += [(f"missing_{label}", value.isNull()), (f"non_positive_{label}", value <= 0)]
    snr = number("OIII_SNR")
    rules += [("missing_snr", snr.isNull()), ("low_snr", snr < limits.min_snr)]
    if "OIII_LUM" in have:
        lum = number("OIII_LUM")
        rules += [
            ("missing_lum", lum.isNull()),
            ("non_positive_lum", lum <= 0),
            ("too_low_lum", lum < limits.min_lum),
            ("too_high_lum", lum > limits.max_lum),
        ]
    if "OIII_LUM_ERR" in have:
        rules.append(("non_positive_lum_err", number("OIII_LUM_ERR") <= 0))
    if "OIII_SIGMA" in have:
        sigma = number("OIII_SIGMA")
        rules += [
            ("sigma_too_low", sigma <= limits.min_sigma),
            ("sigma_too_high", sigma > limits.max_sigma),
        ]
    if "OIII_VOFF" in have:
        rules.append(("voff_too_large", F.abs(number("OIII_VOFF")) > limits.max_abs_voff))
    if limits.max_chi2 is not None and "OIII_CHI2" in have:
        rules.append(("chi2_too_high", number("OIII_CHI2") > limits.max_chi2))
    return rules


def quality_flags(df, limits=QualityLimits()):
    """OIII_VALID and OIII_QUALITY_FLAG; the last matching rule gives the text."""
    df = ensure_columns(df, ["OIII_SNR"])
    if {"OIII_FLUX", "OIII_FLUX_ERR"} <= set(df.columns):
        flux, err = number("OIII_FLUX"), number("OIII_FLUX_ERR")
        snr = F.when(flux.isNotNull() & (err > 0), flux / err).otherwise(number("OIII_SNR"))
        df = df.withColumn("OIII_SNR", snr)
    rules = _quality_rules(df, limits)
    text = F.coalesce(*[F.when(mask, name) for name, mask in reversed(rules)], F.lit("valid"))
    before = F.col("OIII_VALID") if "OIII_VALID" in df.columns else F.lit(True)
    # the flag text is 'valid' exactly when no rule matched
    return df.withColumn("OIII_QUALITY_FLAG", text).withColumn(
        "OIII_VALID", before & (F.col("OIII_QUALITY_FLAG") == "valid")
    )


def safe_ratio(a, b):
    """Larger over smaller magnitude; missing if either side is not finite."""
    a, b = number(a), number(b)
    big, small = F.greatest(F.abs(a), F.abs(b)), F.least(F.abs(a), F.abs(b))
    return F.when(finite(a) & finite(b), big / (small + F.lit(EPS)))


def usable_flag(df):
    """Validity of the line measurement from the best column that exists."""
    for name in ("OIII_VALID", "OIII_USABLE"):
        if name in df.columns:
            return holds(F.lower(F.col(name).cast("string")).isin(*TRUE_WORDS))
    if "OIII_FLUX_CGS" in df.columns:
        return finite_positive("OIII_FLUX_CGS")
    return F.lit(False)
